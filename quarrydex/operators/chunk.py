"""Recursive chunking of texts into spans of bounded token counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

#: Separators from coarse to fine: blank lines, sentence ends, phrase marks, white space.
LEVELS = tuple(re.compile(p) for p in (r"\n\s*\n", r"(?<=[?!.])\s+", r"\s*[();:,]\s*", r"\s+"))
MAX_TOKENS, MIN_TOKENS = 512, 64

Span = tuple[int, int]


def count_words(text: str) -> int:
    return len(text.split())


def count_sql_words(text: str) -> int:
    """Pieces between what SQL's ``\\s`` takes for white space."""
    return len(text.encode("utf-8", "surrogatepass").replace(b"\x0b", b".").split())  # bytes split at ASCII white space alone


def _pieces(text: str, start: int, stop: int, level: int) -> list[Span]:
    """Pieces of a span; a separator stays with the piece on its left."""
    cuts = [start]
    for m in LEVELS[level].finditer(text[start:stop]):
        if 0 < m.end() and start + m.end() < stop:
            cuts.append(start + m.end())
    return list(zip(cuts, [*cuts[1:], stop]))


def _packed(spans: list[Span], size: Callable[[Span], int], most: int, least: int | None) -> list[Span]:
    """Neighbours joined while they fit; a span of at least ``least`` tokens stands alone."""
    out: list[Span] = []
    held, tokens = None, 0
    for span in spans:
        n = size(span)
        alone = least is not None and n >= least
        if held and (alone or tokens + n > most):
            out.append(held)
            held, tokens = None, 0
        if alone:
            out.append(span)
        else:
            held, tokens = (held[0] if held else span[0], span[1]), tokens + n
    return out + ([held] if held else [])


def chunk_spans(text: str, max_tokens: int = MAX_TOKENS, min_tokens: int | None = None, count: Callable[[str], int] = count_words) -> list[Span]:
    """Spans that cover the text end to end, each of at most ``max_tokens`` if words allow."""
    if min_tokens is not None and min_tokens > max_tokens:
        raise ValueError("min_tokens is over max_tokens")
    size = lambda s: count(text[s[0] : s[1]])

    def split(span: Span, level: int) -> list[Span]:
        if level == len(LEVELS) or size(span) <= max_tokens:
            return [span]
        leaves = [leaf for piece in _pieces(text, *span, level) for leaf in split(piece, level + 1)]
        return _packed(leaves, size, max_tokens, min_tokens) if len(leaves) > 1 else leaves

    return split((0, len(text)), 0) if text else []


#: Chunkers by name: each takes a text and the settings' limits and gives spans.
CHUNKERS: dict[str, Callable[[str, int, int | None], list[Span]]] = {"recursive": chunk_spans, "recursive_sql": partial(chunk_spans, count=count_sql_words)}


def chunker(name: str = "recursive", max_tokens: int = MAX_TOKENS, min_tokens: int | None = MIN_TOKENS) -> Callable[[str], list[Span]]:
    """A chunker with its limits; others can be put into ``CHUNKERS``."""
    if name not in CHUNKERS:
        raise ValueError(f"no chunker {name!r}: {sorted(CHUNKERS)}")
    return lambda text: CHUNKERS[name](text, max_tokens, min_tokens)


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = MAX_TOKENS, min_tokens: int | None = MIN_TOKENS, name: str = "recursive") -> DataFrame:
    """(id, ordinal, start, stop, text) of every chunk; offsets count characters.  Null and empty texts have none."""
    cut = chunker(name, max_tokens, min_tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (key, i, a, b, text[a:b])
                for key, text in zip(pdf[id_col], pdf[text_col])
                if text
                for i, (a, b) in enumerate(cut(text))
            ]
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "start", "stop", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInPandas(run, f"{id_col} {kind}, ordinal int, start int, stop int, text string")
