"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

1. Unusable vectors (null, zero, null or non-finite components, no label) link with
   nothing.  Equal vectors of a label collapse to one class with a multiplicity.
2. Each of ``TABLES`` tables rotates a vector ``functions`` times by three rounds of
   random signs and a fast Hadamard transform; a rotation's code is the index and
   sign of the largest component.  Multiprobe adds the codes that the runner-up
   components give, so a vector looks into several buckets a table and is stored in one.
3. A bucket's lookups meet its stored vectors in blocks of one matrix product.  Every
   product is verified in double precision.  A pair that several tables or probes
   find belongs to the first of them, told from the codes that travel with the
   vectors, so each link is counted once without collecting pairs anywhere.
4. A bucket over ``BLOCK`` rows is cut into chunks by a hash; each pair of chunks is
   a task's unit of work, so a hot bucket is spread, and no pair is left out.
5. Tasks return link counts and spanning links; components are joined distributedly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare
from .components import connected_components

THRESHOLD, TABLES, PROBES, SEED = 0.93, 6, 3, 4
#: Rows that one unit of a bucket compares at most on either side; expected rows of a bucket.
BLOCK, BUCKET = 2048, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` times the (unnormalised) Hadamard matrix; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, functions: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket codes; the first probe is the bucket that stores a row."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, size])
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        best = np.zeros((n, functions), np.int64)
        options = []
        for k in range(functions):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, size)):
                y = hadamard(y * signs) / np.sqrt(size)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : probes + 1]
            value = np.take_along_axis(y, order, axis=1)
            sided = 2 * order + (value < 0)
            best[:, k] = sided[:, 0]
            # what it costs to take the j-th largest component instead of the largest
            options += [(k, np.abs(value[:, 0]) - np.abs(value[:, j]), sided[:, j]) for j in range(1, min(probes + 1, size))]
        radix = (2 * size) ** np.arange(functions)
        out[:, t, :] = (best * radix).sum(axis=1)[:, None]
        cost = np.stack([c for _, c, _ in options], axis=1)
        cheapest = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
        shift = np.stack([(code - best[:, k]) * radix[k] for k, _, code in options], axis=1)
        out[:, t, 1:] += np.take_along_axis(shift, cheapest, axis=1)
    return out


def _unit_vectors(pdf: pd.DataFrame, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _expand(tables: int, functions: int, probes: int, kind: str):
    """``probes`` rows for each table, the first also stored; all carry every code."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].str.len()):
                c = codes(_unit_vectors(part, kind), tables, functions, probes)
                n = len(part)
                at = np.repeat(np.arange(n), tables * probes)
                table = np.tile(np.repeat(np.arange(tables), probes), n)
                probe = np.tile(np.arange(probes), n * tables)
                sign = [row.tobytes() for row in c.reshape(n, -1)]
                take = lambda name: part[name].to_numpy()[at]  # noqa: B023, E731
                yield pd.DataFrame({"t": table.astype(np.int32), "label": take("label"), "code": c[at, table, probe], "probe": probe.astype(np.int32), "id": take("id"), "m": take("m"), "v": take("v"), "sign": [sign[k] for k in at]})

    return expand


def _verify(threshold: float, tables: int, probes: int, kind: str):
    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        """Lookups against stored rows of one unit: (id, n, a, b); n links of id, or a spanning link."""
        stored, asked = pdf[pdf["stored"]], pdf[pdf["asked"]]
        if not len(stored) or not len(asked) or pdf["v"].str.len().nunique() > 1:
            parts = [unit(x) for _, x in pdf.groupby(pdf["v"].str.len())] if len(stored) and len(asked) else []
            return pd.concat(parts) if parts else pd.DataFrame({"id": [], "n": [], "other": []})
        x, y = _unit_vectors(stored, kind), _unit_vectors(asked, kind)
        cx = np.stack([np.frombuffer(s, np.int64).reshape(tables, probes) for s in stored["sign"]])
        cy = np.stack([np.frombuffer(s, np.int64).reshape(tables, probes) for s in asked["sign"]])
        ix, iy, mx = stored["id"].values, asked["id"].values, stored["m"].values
        t = int(pdf["t"].iloc[0])
        rows, counts, links = [], [], []
        for at in range(0, len(y), BLOCK):
            for to in range(0, len(x), BLOCK):
                i, j = np.nonzero(y[at : at + BLOCK] @ x[to : to + BLOCK].T >= threshold)
                i, j = i + at, j + to
                differ = iy[i] != ix[j]
                i, j = i[differ], j[differ]
                if not len(i):
                    continue
                # a lookup by y finds x in table s if one of y's codes is x's first; the other way round with the roles changed
                finds = (cy[i] == cx[j][:, :, :1]).any(axis=2)
                found = (cx[j] == cy[i][:, :, :1]).any(axis=2)
                earlier = (finds[:, :t] | found[:, :t]).any(axis=1) | (found[:, t] & (ix[j] < iy[i]))
                own = ~earlier
                rows += [iy[i[own]], ix[j[own]]]
                counts += [mx[j[own]], asked["m"].values[i[own]]]
                links.append(np.stack([iy[i[own]], ix[j[own]]], axis=1))
        if not rows:
            return pd.DataFrame({"id": [], "n": [], "other": []})
        linked = pd.DataFrame({"id": np.concatenate(rows), "n": np.concatenate(counts)}).groupby("id", as_index=False)["n"].sum()
        linked["other"] = pd.Series([None] * len(linked), dtype="Int64")
        pairs = _spanning(np.concatenate(links))
        return pd.concat([linked, pd.DataFrame({"id": pairs[:, 0], "n": np.zeros(len(pairs), np.int64), "other": pd.array(pairs[:, 1], dtype="Int64")})])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by unit, and a unit may go on in the next batch."""
        key = ["t", "label", "code", "cx", "cy"]
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = np.logical_or.reduce([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in key])
            cuts = np.flatnonzero(new) + 1
            edges = [0, *cuts.tolist()]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1 and len(out := unit(pdf.iloc[a:b])):
                    yield out
            rest = pdf.iloc[edges[-1] :]
        if rest is not None and len(out := unit(rest)):
            yield out

    return verify


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Links of a forest with the same components as ``pairs``."""
    ids, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]
    low = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[low], ids[label[low]]], axis=1)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label whose cosine is at least ``threshold`` are linked; those
    of different length never are.  A row that can't link (see the module) has no
    links and is its own component; without an id it has no component and is kept.
    Repeated rows of one id count as one vector each.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    e = F.col(vector_col) if kind == "<f4" else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    big = F.lit(float("inf"))
    fine = F.forall("e", lambda x: F.coalesce((F.abs(x) < big) & ~F.isnan(x), F.lit(False))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), e.alias("e"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = rows.select("vec_id", "label", F.when(usable, F.col("e")).alias("e"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "v": [None if e is None else np.asarray(e, kind).tobytes() for e in pdf["e"]]})

    rows = materialize(rows.mapInPandas(packed, "vec_id long, label string, v binary"), "vectors")
    classes = rows.filter("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("d")).first()
    n, width = size["n"], 2 << max(1, ((size["d"] or 2) // int(kind[-1]) - 1).bit_length())
    functions = 1
    while n > BUCKET * width**functions:  # more functions a table, so that buckets keep their size as rows grow
        functions += 1
    rounds = tables + 4 * (functions - 1)  # longer codes agree less often: more tables keep the recall
    schema = "t int, label string, code long, probe int, id long, m long, v binary, sign binary"
    placed = classes.mapInPandas(_expand(rounds, functions, probes, kind), schema)
    # hot buckets: chunks of either side, each pair of chunks a unit of its own
    bucket, stored = ["t", "label", "code"], F.col("probe") == 0
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("asked"), F.count(F.when(stored, 1)).alias("stored")).filter(F.col("asked") > BLOCK)
    hot = materialize(sizes.select(*bucket, F.ceil(F.greatest(F.col("stored"), F.lit(1)) / BLOCK).cast("int").alias("nx"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("ny")), "hot")
    met = placed.join(hot, bucket, "left").na.fill(1, ["nx", "ny"])
    mine = lambda k: F.array(F.pmod(F.xxhash64("id"), F.col(k)).cast("int"))
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    as_stored = F.when(stored, F.transform(every("ny"), lambda y: F.struct(F.element_at(mine("nx"), 1).alias("cx"), y.alias("cy"), F.lit(True).alias("s"))))
    as_asked = F.transform(every("nx"), lambda x: F.struct(x.alias("cx"), F.element_at(mine("ny"), 1).alias("cy"), F.lit(False).alias("s")))
    places = F.when(stored, F.concat(as_stored, as_asked)).otherwise(as_asked)
    # a row that is stored and asked in one unit travels there once
    both = F.transform(F.array_distinct(F.transform(places, lambda p: F.struct(p["cx"].alias("cx"), p["cy"].alias("cy")))), lambda u: F.struct(
        u["cx"].alias("cx"), u["cy"].alias("cy"),
        (stored & (u["cx"] == F.element_at(mine("nx"), 1))).alias("stored"), (u["cy"] == F.element_at(mine("ny"), 1)).alias("asked"),
    ))
    key = ["t", "label", "code", "cx", "cy"]
    units = met.select("*", F.explode(both).alias("u")).select("t", "label", "code", "u.*", "id", "m", "v", "sign").repartition(*key).sortWithinPartitions(*key)
    found = materialize(units.mapInPandas(_verify(threshold, rounds, probes, kind), "id long, n long, other long"), "links")
    counts = found.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    each = classes.join(counts, "id", "left").join(comp, F.col("id") == F.col("node"), "left").select(
        F.col("label").alias("_l"), F.col("v").alias("_v"), "first", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("c")
    )
    smallest = each.groupBy("c").agg(F.min("first").alias("component_id"))
    each = each.join(smallest, "c").select("_l", "_v", "n_links", "component_id")
    out = rows.join(each, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: Every pair of a label: what the operator returns where its recall is full.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c(id, r) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, min(c.r) FROM l JOIN c ON c.id = l.b JOIN recurring.c AS o ON o.id = l.a GROUP BY l.a, o.r HAVING min(c.r) < o.r)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.r AS component_id, v.vec_id = c.r AS kept FROM v JOIN c ON c.id = v.vec_id
"""
