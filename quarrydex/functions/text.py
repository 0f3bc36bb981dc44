"""Tokens, needles, trigrams and positions as column expressions.

Everything here is built from built-in functions and runs in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = r"(?<=\p{Lower})(?=\p{Upper})|(?<=\p{Upper})(?=\p{Upper}\p{Lower})|(?<=\d)(?=\p{Alpha})|(?<=\p{Alpha})(?=\d)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, case kept."""
    return F.regexp_extract_all(_text(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Words, each followed by its camel-case and digit pieces if it has several."""
    expand = lambda w: F.when(w.rlike(_BOUNDARY), F.concat(F.array(w), F.split(w, _BOUNDARY))).otherwise(F.array(w))
    words = word_tokens(text)  # most texts hold no boundary at all, and one look at the whole text tells
    return F.when(_text(text).rlike(_BOUNDARY), F.flatten(F.transform(words, expand))).otherwise(words)


def noop_tokens(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(_text(text), r"\s+"), lambda x: x != "")


def tokens(text: Column, kind: str = "code") -> Column:
    """Tokens by the tokenizer setting: noop, word, or code for anything else."""
    return {"noop": noop_tokens, "word": word_tokens}.get(kind, code_tokens)(text)


_WORD_BYTES = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalnum())
_OTHERS = bytes(set(range(256)) - set(_WORD_BYTES))
_KEPT = bytes.maketrans(_OTHERS, b" " * len(_OTHERS))
_LOWERED = _KEPT.lower()
_CLASSES = bytes(b"0"[0] if chr(c).isdigit() else b"A"[0] if chr(c).isupper() else c if c == 32 else b"a"[0] for c in _KEPT)
#: Where words turn from one class of characters to another.
_TURNS = (b"aA", b"AAa", b"0a", b"0A", b"a0", b"A0")
_BOUNDARY_BYTES = re.compile(rb"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def term_counter(kind: str = "code", wanted: dict[bytes, int] | None = None) -> Callable[[bytes | None], tuple[int, dict]]:
    """A function from a text in UTF-8 to its number of lower-case tokens and how often each stands in it.

    It gives what ``tokens`` does, on a worker: for the kinds ``word`` and ``code``, whose
    tokens are ASCII.  With ``wanted``, its terms alone are counted, under its numbers.
    """

    def count(text: bytes | None) -> tuple[int, dict]:
        if not text:
            return 0, {}
        terms = text.translate(_LOWERED).split()
        if kind != "word":
            shapes = text.translate(_CLASSES)
            if any(turn in shapes for turn in _TURNS):  # most texts have none
                each = shapes.split()
                turned = {shape for shape in set(each) if any(turn in shape for turn in _TURNS)}
                for word in [w for w, shape in zip(text.translate(_KEPT).split(), each) if shape in turned]:
                    terms += [piece.lower() for piece in _BOUNDARY_BYTES.split(word)]
        if wanted is None:
            return len(terms), Counter(terms)
        return len(terms), {wanted[t]: n for t, n in Counter(filter(wanted.__contains__, terms)).items()}

    return count


def without_stop_words(found: Column, stop: list[str]) -> Column:
    """Tokens whose lower-case form isn't a stop word."""
    if not stop:
        return found
    words = F.array(*[F.lit(w.lower()) for w in stop])
    return F.filter(found, lambda x: ~F.array_contains(words, F.lower(x)))


def repeats(boost: float | None) -> int:
    """How often a boosted field's tokens stand in a needle; none at all without a boost."""
    return 0 if not boost else max(1, round(boost))


def search_needle(fields: dict[str, Column], boosts: dict[str, float], kind: str = "code") -> Column:
    """Text that an index sees: each field's tokens as often as its boost says.

    ``header`` stands in for ``name`` where it isn't empty.  Without any boost the
    body is taken once.
    """
    used = boosts or {"body": 1}
    parts = []
    for name, boost in used.items():
        n = repeats(boost)
        if not n or name not in fields:
            continue
        source = fields[name]
        if name == "name" and "header" in fields:
            source = F.when(_text(fields["header"]) != "", fields["header"]).otherwise(source)
        found = tokens(source, kind)
        parts.append(F.flatten(F.array_repeat(found, n)) if n > 1 else found)
    return F.array_join(F.concat(*parts), " ") if parts else F.lit("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces; texts under three characters have none."""
    last = F.greatest(F.length(text) - 2, F.lit(1))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(3))))
    return F.when(F.length(text) >= 3, grams).otherwise(F.array().cast("array<string>"))


def embedding_text(docstring: Column, body: Column) -> Column:
    """What a node's vector is made of: documentation and body, or the body alone."""
    return F.when(_text(docstring) != "", F.concat(docstring, F.lit("\n"), _text(body))).otherwise(_text(body))


def dedent(text: Column) -> Column:
    """Lines without the white space that all lines with text begin with."""
    lines = F.split(text, "\n")
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    depth = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), indent)), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, depth + 1, F.length(x) + 1)), "\n")


def line_at(text: Column, offset: Column) -> Column:
    """One-based line of a character offset."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", "")) + 1


def byte_at(text: Column, offset: Column) -> Column:
    """Byte offset in UTF-8 of a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), offset))


def is_text(content: Column) -> Column:
    """Bytes that are UTF-8 and hold no NUL."""
    as_text = content.cast("string")
    return F.is_valid_utf8(as_text) & (F.instr(as_text, "\x00") == 0)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
