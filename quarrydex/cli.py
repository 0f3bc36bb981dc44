"""Command line: scan, stats, summary and search; settings from flags, environment, an env file, TOML and JSON."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib
from dataclasses import fields, is_dataclass
from typing import Any

from .operators.statistics import repo_stats
from .plans.tools import Engine, to_structured_text
from .schema import Settings
from .session import build
from .sources.store import Store

PREFIX = "QUARRYDEX_"


def _apply(target: Any, values: dict[str, Any]) -> None:
    kinds = {f.name: f for f in fields(target)}
    for key, value in values.items():
        if key not in kinds:
            raise ValueError(f"unknown setting {key!r}")
        old = getattr(target, key)
        if is_dataclass(old):
            _apply(old, value)
        elif isinstance(old, tuple):
            setattr(target, key, tuple(value))
        elif isinstance(value, str) and not isinstance(old, str):
            setattr(target, key, json.loads(value.lower() if isinstance(old, bool) else value))
        else:
            setattr(target, key, value)


def _nested(pairs: dict[str, str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in pairs.items():
        *path, last = key.lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def read_env_file(path: str) -> dict[str, str]:
    """NAME=VALUE lines; blank lines and comments are passed over, quotes around a value go."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load_settings(config: str | None = None, flags: dict[str, str] | None = None, env: dict[str, str] | None = None, env_file: str | None = None) -> Settings:
    """Settings from a TOML or JSON file, an env file, the environment, then flags; later ones win.

    Nested settings are named with two underscores, as in ``QUARRYDEX_SEARCH__RRF_K``.
    """
    out = Settings()
    if config:
        with open(config, "rb") as f:
            _apply(out, json.load(f) if config.endswith(".json") else tomllib.load(f))
    env = (read_env_file(env_file) if env_file else {}) | dict(os.environ if env is None else env)
    _apply(out, _nested({k[len(PREFIX) :]: v for k, v in env.items() if k.startswith(PREFIX)}))
    _apply(out, _nested(flags or {}))
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrydex")
    p.add_argument("--store", required=True)
    p.add_argument("--repo", action="append", required=True, metavar="NAME=PATH")
    p.add_argument("--config")
    p.add_argument("--env-file")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--master", default="local[*]")
    p.add_argument("command", choices=["scan", "stats", "summary", "search", "files"])
    p.add_argument("what", nargs="*")
    a = p.parse_args(argv)
    settings = load_settings(a.config, dict(x.split("=", 1) for x in a.set), env_file=a.env_file)
    engine = Engine.with_embedder(Store(build(a.master), a.store), dict(x.split("=", 1) for x in a.repo), settings)
    if a.command == "scan":
        out: Any = [{"repo": k, **r.counts, "errors": len(r.errors), "seconds": round(r.seconds, 2)} for k, r in engine.refresh().items()]
    elif a.command == "stats":
        names = {"files": "files", "packages": "packages", "nodes": "nodes", "edges": "import_edges"}
        out = [r.asDict() for r in repo_stats({k: engine.store.read(t) for k, t in names.items()}).collect()]
    elif a.command == "summary":
        out = engine.summarize_files(a.what, "documentation")
    elif a.command == "search":
        out = engine.search_project(" ".join(a.what))
    else:
        out = engine.list_files(a.what[0] if a.what else "*")
    print(to_structured_text(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
