"""Vector expressions and an offline embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a null or zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Rows and bytes of a block of vectors: two blocks' products take at most 32 MB.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20


def matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors as doubles) of an array of lists, in pieces of up to ``BLOCK_ROWS`` vectors.

    Null and zero vectors, and those with a null or non-finite component, are in none.
    """
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            matrix = values[starts[some, None] + np.arange(dim)]
            length = np.einsum("ij,ij->i", matrix, matrix)
            good = np.isfinite(length) & (length > 0)
            if good.any():
                yield dim, some[good], matrix[good]


def blocks(df: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    """Rows of up to ``BLOCK_ROWS`` vectors: (dim, ids, values as bytes of doubles), names begun with ``prefix``.

    Null and zero vectors, and those with a null or non-finite component, are in none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for dim, rows, matrix in matrices(batch.column(1)):
                taken = ids.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), pa.array([matrix.tobytes()], pa.binary())],
                    names=[f"{prefix}dim", f"{prefix}ids", f"{prefix}values"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, vector_col).mapInArrow(run, f"{prefix}dim int, {prefix}ids array<{kind}>, {prefix}values binary")


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, their terms added one after another."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def block_scores(a: np.ndarray, b: np.ndarray, least: float | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, cosine to six decimals) of the pairs from ``least`` on.

    With ``most``, only those that are among a row of ``b``'s best ``most``, and all that
    tie with them.  A product whose last decimal hangs on the order of the additions is
    reckoned again, term by term, so that equal vectors have equal scores.
    """
    la, lb = np.sqrt(_in_turn(a, a)), np.sqrt(_in_turn(b, b))
    raw = (b @ a.T) / lb[:, None] / la
    near = 2e-6  # a rounding moves a score by less than half of this
    floor = np.full((len(b), 1), -np.inf if least is None else least - near)
    if most is not None and most < len(a):
        floor = np.maximum(floor, np.partition(raw, len(a) - most, axis=1)[:, len(a) - most, None] - near)
    j, i = np.nonzero(raw >= floor)
    score = raw[j, i]
    scaled = np.abs(score) * 1e6
    doubtful = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    for k in range(0, len(doubtful), BLOCK_ROWS):
        some = doubtful[k : k + BLOCK_ROWS]
        score[some] = _in_turn(a[i[some]], b[j[some]]) / (la[i[some]] * lb[j[some]])
    score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5) / 1e6, score) + 0.0
    if least is not None:
        keep = score >= least
        i, j, score = i[keep], j[keep], score[keep]
    return i, j, score


def fit_dim(vector: Column, dim: int) -> Column:
    """A vector cut or padded with zeros to ``dim`` components."""
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(vector), F.lit(0)))
    return F.slice(F.concat(vector, pad), 1, dim)


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    each = df.select(*keys, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    return pooled.select(*keys, F.transform("p", lambda s: s["x"]).alias(vector))


def token_windows(tokens: Column, size: int, overlap: int = 64) -> Column:
    """Windows of ``size`` tokens that overlap; one window for a short list."""
    stride = max(1, size - overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(stride))
    return F.transform(starts, lambda i: F.slice(tokens, i, size))


def hashing_embedder(dim: int = 256):
    """A deterministic feature-hashing embedder as a column function of texts.

    Signed counts of hashed lower-case words and their three-letter pieces, scaled to
    length one; an empty text has the zero vector.
    """
    import zlib

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[tuple[int, float]]] = {}
        for texts in batches:
            rows = []
            for text in texts:
                v = np.zeros(dim, np.float32)
                for w in (text or "").lower().split():
                    hits = known.get(w)
                    if hits is None:
                        if len(known) > 100_000:
                            known.clear()
                        codes = [zlib.crc32(p.encode()) for p in [w, *(w[i : i + 3] for i in range(len(w) - 2))]]
                        hits = known[w] = [(c % dim, 1.0 if c >> 31 else -1.0) for c in codes]
                    for at, sign in hits:
                        v[at] += sign
                n = float(np.linalg.norm(v))
                rows.append(v / n if n else v)
            yield pd.Series(rows)

    return embed


#: Makers of embedders, by the name that ``Settings.embedder`` has; each takes the dimension.
EMBEDDERS = {"hashing": hashing_embedder}


def register_embedder(name: str, make) -> None:
    """Add an embedder of one's own: ``make(dim)`` gives a column function of texts; names are unique."""
    if name in EMBEDDERS:
        raise ValueError(f"there is an embedder {name!r} already")
    EMBEDDERS[name] = make


def embedder(name: str, dim: int = 256):
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}: {sorted(EMBEDDERS)}")
    return EMBEDDERS[name](dim)
