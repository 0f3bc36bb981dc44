"""Globs, subsequence matching, virtual paths and name scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REPO_PREFIX = ".virtual-path"


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ``*`` crosses slashes, ``[!x]`` negates, ``\\`` escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))) > 0:
            inside = pattern[i + 1 : end]
            negated = inside.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inside[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_prefix(pattern: str) -> str:
    """The literal beginning of a glob, which a scan can use."""
    return re.split(r"[*?\[\\]", pattern, maxsplit=1)[0]


def glob_match(path: Column, pattern: str) -> Column:
    if not pattern:
        return F.lit(False)
    prefix = glob_prefix(pattern)
    match = path.rlike(glob_regex(pattern))
    return path.startswith(prefix) & match if prefix else match


def subsequence_regex(needle: Column) -> Column:
    """Pattern that finds the needle's characters in order, anything between them."""
    chars = F.filter(F.split(F.lower(needle), ""), lambda x: x != "")
    safe = F.transform(chars, lambda x: F.when(x.rlike("[A-Za-z0-9 ]"), x).otherwise(F.concat(F.lit("\\"), x)))
    return F.concat(F.lit("^.*"), F.array_join(safe, ".*"), F.lit(".*$"))


def filename_score(base_match: Column, path_match: Column, tri_hits: Column, path: Column) -> Column:
    return (
        F.when(base_match, 20).otherwise(0) + F.when(path_match, 10).otherwise(0) + 2 * F.coalesce(tri_hits, F.lit(0)) - F.length(path) / 100.0
    ).cast("double")


def virtual_path(repo: Column, path: Column, default_repo: str, project_paths: bool = False) -> Column:
    """A file's path in the project: bare for the default repository unless project paths are on."""
    if project_paths:
        return F.concat_ws("/", repo, path)
    return F.when(repo == default_repo, path).otherwise(F.concat_ws("/", F.lit(REPO_PREFIX), repo, path))


def split_virtual_path(path: Column, default_repo: str, project_paths: bool = False) -> Column:
    """(repo, path) of a virtual path; the inverse of ``virtual_path``."""
    parts = F.split(path, "/")
    rest = lambda n: F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    if project_paths:
        return F.struct(F.element_at(parts, 1).alias("repo"), rest(1).alias("path"))
    other = (F.element_at(parts, 1) == REPO_PREFIX) & (F.size(parts) > 2)
    return F.struct(F.when(other, F.get(parts, F.lit(1))).otherwise(F.lit(default_repo)).alias("repo"), F.when(other, rest(2)).otherwise(path).alias("path"))


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def module_path(path: Column, language: Column) -> Column:
    """A file's package path by its language's rule."""
    plain = stem(path)
    dotted = F.replace(plain, F.lit("/"), F.lit("."))
    python = F.regexp_replace(dotted, r"(^|\.)__init__$", "")
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
    return (
        F.when(language == "python", python)
        .when(language.isin("javascript", "typescript", "text", "markdown"), dotted)
        .when(language.isin("c", "cpp"), path)
        .when(language == "terraform", plain)
        .when(language == "go", folder)
    )


def package_name(virtual: Column) -> Column:
    return F.substring_index(virtual, "/", -1)
