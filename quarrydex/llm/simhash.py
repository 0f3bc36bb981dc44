"""SimHash near-duplicates found with a Gray-order hierarchical index.

1. Every text gets a 64-bit SimHash over hashed word shingles (Arrow batches).
2. Equal fingerprints collapse to one row, so copies never meet again.
3. Fingerprints within ``max_bits`` agree on one of ``max_bits + 1`` bit segments:
   each is routed once per segment, and only routes with equal segment values are
   compared.  A route that too many fingerprints share is split by segments of the
   bits it doesn't fix yet (again no pair is lost), so that a task's index is bounded.
4. A task sorts the fingerprints of its routes by Gray rank, factors the bits that
   neighbours share into masked patterns of upper nodes, and descends from the
   roots with all queries at once: each node adds the differing bits of the pattern
   it introduces, and a node over the limit is pruned with everything below it.
5. Tasks return spanning links only; the components are joined up distributedly.

A contract may fix what a fingerprint is (``near_duplicates``' defaults).  Where the
aim is a similarity of word shingles, no limit on differing bits finds every pair:
``similar_texts`` verifies the pairs that this index finds, and the exact join of
``near_copies`` adds those between the components that they leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import near_copies
from .common import materialize, prepare
from .components import connected_components

#: Fingerprints that may share a route before it is split.
ROUTE_LIMIT = 1 << 20
#: Rows that a task gathers before it builds an index of the whole routes among them.
HELD = 1 << 16
#: Children per node of the index; pairs expanded at a time.
FANOUT, FRONTIER = 8, 1 << 18
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text's UTF-8 bytes as an unsigned integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        x = xxhash.xxh64_intdigest
        hashes = [x(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    return near_copies.majority(np.array(hashes, dtype="<u8"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the Gray code's order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy over fingerprints sorted by bucket and Gray rank.

    ``levels[0]`` are the fingerprints, the last level has one root a bucket.  A
    level holds each node's child range, its leaf range, the pattern that all
    leaves below share and the mask of the bits that the node adds to its parent's.
    """

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), bucket))
        self.fp, bucket = fp[self.order], bucket[self.order]
        n = len(fp)
        ones, zeros = self.fp, ~self.fp
        leaf = np.arange(n)
        levels = [{"ones": ones, "mask": np.full(n, ~np.uint64(0)), "end": leaf + 1, "start": leaf, "bucket": bucket}]
        while True:
            low = levels[-1]
            at = low["bucket"]
            m = len(at)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            if len(first) == m and len(levels) > 1:
                break
            within = np.arange(m) - np.repeat(first, np.diff(np.append(first, m)))
            cut = np.flatnonzero(within % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            stop = np.append(cut[1:], m)
            levels.append({"ones": ones, "mask": ones | zeros, "child": cut, "stop": stop, "end": low["end"][stop - 1], "start": low["start"][cut], "bucket": at[cut]})
            low["mask"] = low["mask"] & ~np.repeat(levels[-1]["mask"], stop - cut)
        self.levels = levels
        top = levels[-1]
        self.root = np.repeat(np.arange(len(top["end"])), top["end"] - top["start"])

    def components(self, max_bits: int) -> np.ndarray:
        """For each sorted fingerprint, the smallest position linked with it, directly or not."""
        n, levels = len(self.fp), self.levels
        label = np.arange(n)
        for at in range(0, n, FRONTIER // 4):
            q = np.arange(at, min(n, at + FRONTIER // 4))
            # a node whose leaves all are of the query's own component has nothing to add
            same = [np.where(np.minimum.reduceat(label, x["start"]) == np.maximum.reduceat(label, x["start"]), label[x["start"]], -1) for x in levels]
            stack = [(len(levels) - 1, q, self.root[q], np.zeros(len(q), np.uint8))]
            while stack:
                k, q, node, far = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(k, q[:half], node[:half], far[:half]), (k, q[half:], node[half:], far[half:])]
                    continue
                x = levels[k]
                far = far + np.bitwise_count((self.fp[q] ^ x["ones"][node]) & x["mask"][node])
                keep = (far <= max_bits) & (x["end"][node] > q + 1) & (same[k][node] != label[q])
                q, node, far = q[keep], node[keep], far[keep]
                if not len(q):
                    continue
                if k == 0:
                    _unite(label, q, node)
                    continue
                size = x["stop"][node] - x["child"][node]
                base = np.repeat(x["child"][node] - np.cumsum(size) + size, size)
                stack.append((k - 1, np.repeat(q, size), base + np.arange(size.sum()), np.repeat(far, size)))
        return label


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _links(max_bits: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches hold whole routes in order; a route may go on in the next batch."""
        rest: list[pd.DataFrame] = []
        held, wait = 0, HELD

        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            new = (pdf["mask"].values[1:] != pdf["mask"].values[:-1]) | (pdf["value"].values[1:] != pdf["value"].values[:-1])
            index = GrayIndex(pdf["fp"].values.astype(np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(new)]))
            label, node = index.components(max_bits), pdf["node"].values[index.order]
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": node[linked], "b": node[label[linked]]})

        for pdf in batches:
            if not len(pdf):
                continue
            rest.append(pdf)
            held += len(pdf)
            if held < wait:
                continue
            whole = pd.concat(rest, ignore_index=True)
            last = (whole["mask"] == whole["mask"].iloc[-1]) & (whole["value"] == whole["value"].iloc[-1])
            if last.all():
                rest, wait = [whole], 2 * held  # a long route is put together ever more seldom
            else:
                yield found(whole[~last])
                rest, wait = [whole[last]], HELD
            held = len(rest[0])
        if rest:
            yield found(pd.concat(rest, ignore_index=True))

    return links


def _segments(mask: int, parts: int) -> list[int]:
    """``mask`` extended by each of ``parts`` runs of the bits it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def _routes(nodes: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """(mask, value, *nodes): fingerprints within ``max_bits`` share a row's mask and value."""
    parts, columns = max_bits + 1, nodes.columns
    level = _segments(0, parts)
    routes = nodes.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in level])))
    for _ in range(3):
        routes = routes.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        size = routes.groupBy("mask", "value").count().filter(F.col("count") > limit)
        if size.isEmpty():
            break
        deeper = F.create_map(*[x for m in level for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in _segments(m, parts)]))])
        routes = routes.join(size, ["mask", "value"], "left")
        masks = F.when(F.col("count").isNotNull(), deeper[F.col("mask")]).otherwise(F.array("mask"))
        routes = routes.select(*columns, F.explode(masks).alias("mask"))
        level = [s for m in level for s in _segments(m, parts)] + level
    return routes.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), *columns)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with a column ``fp`` (signed 64 bits); null and blank texts get 0."""
    prepare(docs.sparkSession)

    @F.pandas_udf(LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return docs.withColumn("fp", simhash(F.col(text).cast("binary")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3, route_limit: int = ROUTE_LIMIT
) -> DataFrame:
    """One row per document: id, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links of ``max_bits`` or fewer
    differing bits, the document's own included.  Null and blank texts have the
    fingerprint zero and link like any other; rows of equal id keep a row each (all
    texts of an id are joined to its component); rows without an id get a fingerprint
    and no component, and link nothing.  Other columns of ``docs`` are ignored.
    """
    fps = fingerprints(_texts(docs, id_col, text_col), "text", shingle).select("doc_id", "fp")

    return _components(materialize(fps, "fps"), "fp", lambda nodes: _fingerprint_links(nodes, max_bits, route_limit)).select("doc_id", "fp", "component_id")


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, max_bits: int = 7, route_limit: int = ROUTE_LIMIT, block: int = near_copies.BLOCK
) -> DataFrame:
    """One row per document: id and ``component_id``, linked by the similarity of their word shingles.

    All pairs of texts whose shingles' Jaccard similarity is at least ``similarity`` are
    linked, as are texts of equal shingles.  The Gray-order index proposes pairs whose
    SimHashes of distinct shingles differ in ``max_bits`` or fewer bits, an exact join the
    rest; every pair is verified.  Nulls, blanks, repeated rows and ids as above.
    """
    texts = _texts(docs, id_col, text_col)
    marked = materialize(near_copies.keys(texts, shingle), "marks")

    def propose(nodes: DataFrame) -> DataFrame:
        firsts = materialize(nodes.groupBy("fp").agg(F.min("key").alias("node")), "fps")
        same = nodes.join(firsts, "fp").filter("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
        return same.unionAll(_fingerprint_links(firsts, max_bits, route_limit))

    found = near_copies.links(texts.filter("doc_id IS NOT NULL"), marked, shingle, similarity, propose, block)

    def edges(nodes: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("key").alias(c), F.col("node").alias(f"node_{c}")) for c in "ab")
        return found.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    return _components(marked.select("doc_id", "key"), "key", edges).select("doc_id", "component_id")


def _fingerprint_links(nodes: DataFrame, max_bits: int, route_limit: int) -> DataFrame:
    """(a, b): links between ``nodes`` (fp, node) that span the components of near fingerprints."""
    routed = _routes(nodes.select("fp", "node"), max_bits, route_limit).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return routed.mapInPandas(_links(max_bits), "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _components(fps: DataFrame, key: str, links) -> DataFrame:
    """``fps`` with ``component_id``; ``links`` gives (a, b) over nodes (key, node), the smallest ids of the keys."""
    known = fps.filter("doc_id IS NOT NULL")
    nodes = materialize(known.groupBy(key).agg(F.min("doc_id").alias("node")), "nodes")
    several = known.groupBy("doc_id").agg(F.count_distinct(key).alias("n")).filter("n > 1").select("doc_id")
    own = known.join(several, "doc_id").join(nodes, key).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comp = connected_components(links(nodes).unionAll(own))
    of_fp = nodes.join(comp, "node", "left").select(key, F.coalesce("component", "node").alias("c"))
    return fps.join(of_fp, key, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("c")))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of ``docs`` that are the smallest of their component; rows without an id stay."""
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
