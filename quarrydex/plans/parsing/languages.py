"""Which parser reads which file, and each language's keywords."""

from __future__ import annotations

from collections.abc import Callable

from . import braces, hcl, prose, python_source
from .model import Source, flatten

PARSERS: dict[str, Callable] = {
    "python": python_source.parse,
    "c": braces.parser(braces.C),
    "cpp": braces.parser(braces.Cpp),
    "go": braces.parser(braces.Go),
    "javascript": braces.parser(braces.JavaScript),
    "typescript": braces.parser(braces.TypeScript),
    "terraform": hcl.parse,
    "markdown": prose.parse_markdown,
    "text": prose.parse_text,
}
EXTENSIONS = {
    ".py": "python", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".ipp": "cpp", ".tpp": "cpp", ".go": "go",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".tf": "terraform", ".tfvars": "terraform",
    ".md": "markdown", ".markdown": "markdown", ".txt": "text",
}
#: Parsers that cut texts into chunks.
PROSE = ("markdown", "text")
#: Languages whose files belong to a package.
PACKAGED = ("python", "c", "cpp", "go", "javascript", "typescript", "terraform")

_C = "auto break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while"
_JS = "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static super switch this throw true false try typeof undefined var void while with yield"
KEYWORDS = {
    "python": frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda none nonlocal not or pass raise return self true false try while with yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map nil package range return select struct switch type var".split()),
    "c": frozenset(_C.split()),
    "cpp": frozenset((_C + " bool catch class constexpr delete explicit false final friend mutable namespace new noexcept nullptr operator override private protected public template this throw true try typename using virtual").split()),
    "javascript": frozenset(_JS.split()),
    "typescript": frozenset((_JS + " abstract any as boolean declare enum implements interface keyof namespace never number private protected public readonly string type unknown").split()),
}


def register(key: str, parse: Callable, extensions: list[str]) -> None:
    """Add a parser of one's own; keys are unique."""
    if key in PARSERS:
        raise ValueError(f"there is a parser {key!r} already")
    PARSERS[key] = parse
    EXTENSIONS.update({e: key for e in extensions})


def extension_map(extra: dict[str, list[str]] | None = None, override: dict[str, str] | None = None) -> dict[str, str]:
    """Extensions to parser keys: built-in, then by language, then single ones; later ones win."""
    out = dict(EXTENSIONS)
    for key, suffixes in (extra or {}).items():
        out.update({s if s.startswith(".") else f".{s}": key for s in suffixes})
    out.update({s if s.startswith(".") else f".{s}": key for s, key in (override or {}).items()})
    if unknown := {k for k in out.values() if k not in PARSERS}:
        raise ValueError(f"unknown parsers: {sorted(unknown)}")
    return out


def parse(key: str, path: str, text: str, files: frozenset[str] | None = None, chunks: tuple[int, int] | None = None) -> tuple[list[dict], list[dict]]:
    """Rows of nodes and of imports of one file.

    With ``files``, the paths of the repository, imports are resolved; without them they
    keep their candidates.  ``chunks`` has the most and least tokens of a chunk of prose.
    """
    nodes, imports = PARSERS[key](path, text, chunks) if chunks and key in PROSE else PARSERS[key](path, text)
    if files is not None:
        for i in imports:
            i.resolve(files)
    return flatten(nodes, Source(text)), [vars(i) for i in imports]
