"""All pairs of texts whose word shingles have at least a given Jaccard similarity.

An exact prefix filter; no pair is left to chance (shingles, and sets of them, are
told apart by 64-bit hashes):

1. *Sieve.*  A text is the set of its shingles' hashes; equal sets are one node.  Of
   sets with similarity t, the ``n - ceil(t n) + k`` smallest hashes of each have ``k``
   in common.  Only these are sent, and a node that shares fewer than ``k`` of them with
   any others has no partner and goes.
2. *Order.*  The shingles of the nodes left are put in order of their frequency.  Two
   similar sets share one of the first ``n - ceil(t n) + 1``, those of a single node
   counted; so a frequent shingle comes last and seldom makes candidates.
3. *Candidates.*  Pairs proposed by the caller (SimHash links), and for each shingle
   its first node with every other, are verified and make components.  Then nodes that
   share a prefix shingle are paired unless they are in one component already, or their
   sizes or the places of the shingle rule the similarity out.
4. *Verify.*  Every candidate is checked on the whole sets.

A shingle that many texts hold is sent once a batch of texts, not once a text; pairs
of the nodes that share it are made in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, discard, materialize, prepare
from .components import connected_components

#: Shingles of the sets that are ordered together.
SETS = 1 << 17
#: Nodes of one shingle that are paired in one block; pairs put out at a time.
BLOCK, PAIRS = 1 << 12, 1 << 18
#: Share of a set that the sieve asks for in common, beyond the first of it.
EXTRA = 0.05
#: Guards the comparison of counts with a decimal similarity.
SLACK = 1e-9
_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes ``h``."""
    ones = np.zeros(2048, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[at : at + (1 << 15)], dtype="<u8")
        ones += np.bincount((part.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    per_bit = (ones.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * per_bit > len(h), bitorder="little").view("<u8")[0])


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    size = min(shingle, len(h))
    g = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    g = (g ^ (g >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(g ^ (g >> np.uint64(33)))


def set_key(s: np.ndarray) -> int:
    """Signed hash of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) or 1 if len(s) else 0


def keys(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, fp) of ``docs`` (doc_id, text): texts of one key have equal sets; ``fp`` is the set's SimHash."""
    prepare(docs.sparkSession)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("near copies")
        for pdf in batches:
            sets = [shingle_set(t, shingle) for t in pdf["text"]]
            fp = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": np.fromiter(map(set_key, sets), np.int64, len(sets)), "fp": fp})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(mark, "doc_id long, key long, fp long")


def _packed(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """A row a bucket with each column's values in bytes."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
    some = np.flatnonzero(np.diff(ends, prepend=0))
    cuts = [(int(ends[b - 1]) if b else 0, int(ends[b])) for b in some]
    out = {"bucket": some.astype(np.int32)}
    for name, v in columns.items():
        v = v[order]
        out[name] = [v[i:j].tobytes() for i, j in cuts]
    return pd.DataFrame(out)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _found(node: np.ndarray) -> pd.DataFrame:
    value, found = np.unique(node, return_counts=True)
    return pd.DataFrame({"node": value, "found": found.astype(np.int64)})


# --- 1. sieve


def _need(size: int, similarity: float, extra: float) -> tuple[int, int]:
    """(hashes to send, hashes that must be shared) of a set; a partner of any size sends enough of its own."""
    first = size - int(np.ceil(similarity * size - SLACK)) + max(1, int(extra * size))
    return min(size, first), max(1, int(extra * similarity * size - SLACK))


def _send(shingle: int, similarity: float, extra: float, buckets: int):
    """Rows with a bucket carry (token, node) pairs; rows of bucket -1 what a batch found by itself."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = {set_key(s): s for s in (shingle_set(t, shingle) for t in pdf["text"]) if len(s)}
            if not sets:
                continue
            wants = [_need(len(s), similarity, extra) for s in sets.values()]
            token = np.concatenate([s[:p] for s, (p, _) in zip(sets.values(), wants)])
            node = np.repeat(np.fromiter(sets, np.int64, len(sets)), [p for p, _ in wants])
            order = np.argsort(token, kind="stable")
            token, node = token[order], node[order]
            first = _starts(token)
            several = np.diff(np.append(first, len(token))) > 1
            here = np.repeat(several, np.diff(np.append(first, len(token))))
            own = _found(node[here]).set_index("node")["found"].reindex(list(sets), fill_value=0)
            yield pd.DataFrame({"bucket": -1, "token": None, "node": None, "id": list(sets), "found": own.to_numpy(), "need": [k for _, k in wants]})
            # a token of several nodes here is known to be shared: one row tells the others
            token, node = token[first], np.where(several, 0, node[first])
            sent = _packed(token % np.uint64(buckets), buckets, {"token": token, "node": node})
            yield sent.assign(id=0, found=0, need=0)

    return send


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of each node's hashes in this bucket others have too."""
    token, node = [], []
    for pdf in batches:
        token += list(pdf["token"])
        node += list(pdf["node"])
    token, node = np.frombuffer(b"".join(token), np.uint64), np.frombuffer(b"".join(node), np.int64)
    if not len(token):
        return
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    once = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
    token, node = token[once], node[once]
    first = _starts(token)
    count = np.diff(np.append(first, len(token)))
    known = np.minimum.reduceat(np.where(node == 0, 0, 1), first) == 0
    shared = np.repeat((count > 1) | known, count) & (node != 0)
    yield _found(node[shared])


def _sieve(texts: DataFrame, shingle: int, similarity: float, extra: float) -> DataFrame:
    """(node) of every set that may have a partner, and some more."""
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = materialize(texts.select("text").mapInPandas(_send(shingle, similarity, extra, buckets), "bucket int, token binary, node binary, id long, found long, need long"), "sent")
    own = sent.filter("bucket = -1").select(F.col("id").alias("node"), "found", "need")
    met = sent.filter("bucket >= 0").select("bucket", "token", "node").repartitionById(buckets, "bucket").select("token", "node").mapInPandas(_meet, "node long, found long")
    both = own.unionAll(met.select("node", "found", F.lit(0).alias("need")))
    left = both.groupBy("node").agg(F.sum("found").alias("found"), F.max("need").alias("need")).filter("found >= need").select("node")
    left = materialize(left, "left")
    discard(sent)
    return left


# --- 2. order


def _sets(shingle: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, found, held = [], {}, 0

            def close() -> None:
                size = np.fromiter(map(len, found.values()), np.int32, len(found))  # noqa: B023
                rows.append((np.fromiter(found, np.int64, len(found)).tobytes(), size.tobytes(), np.concatenate(list(found.values())).tobytes()))  # noqa: B023

            for t in pdf["text"]:
                s = shingle_set(t, shingle)
                if len(s):
                    found[set_key(s)] = s
                    held += len(s)
                if held >= SETS:
                    close()
                    found, held = {}, 0
            if found:
                close()
            yield pd.DataFrame(rows, columns=["node", "size", "token"])

    return sets


def _ask(buckets: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, token in zip(pdf["block"].tolist(), pdf["token"]):
                value, n = np.unique(np.frombuffer(token, np.uint64), return_counts=True)
                yield _packed(value % np.uint64(buckets), buckets, {"token": value, "n": n.astype(np.int32)}).assign(block=block)[["bucket", "block", "token", "n"]]

    return ask


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tells each block how many nodes have its tokens, if several have."""
    block, token, n = [], [], []
    for pdf in batches:
        block += pdf["block"].tolist()
        token += list(pdf["token"])
        n += list(pdf["n"])
    if not block:
        return
    block = np.repeat(np.array(block, np.int64), [len(t) // 8 for t in token])
    token, n = np.frombuffer(b"".join(token), np.uint64), np.frombuffer(b"".join(n), np.int32)
    order = np.argsort(token, kind="stable")
    block, token, n = block[order], token[order], n[order]
    first = _starts(token)
    total = np.repeat(np.add.reduceat(n.astype(np.int64), first), np.diff(np.append(first, len(token))))
    several = total > 1
    block, token, total = block[several], token[several], total[several].astype(np.int32)
    order = np.argsort(block, kind="stable")
    block, token, total = block[order], token[order], total[order]
    first = _starts(block)
    for at in range(0, len(first), 500):
        part = [(int(block[i]), token[i:j].tobytes(), total[i:j].tobytes()) for i, j in zip(first[at : at + 500].tolist(), np.append(first, len(block))[at + 1 : at + 501].tolist())]
        yield pd.DataFrame(part, columns=["block", "token", "n"])


def _arrange(similarity: float):
    def arrange(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a node that may have a partner: its shared tokens, and of its prefix those that are shared."""
        for pdf in batches:
            for node, size, token, told in zip(pdf["node"], pdf["size"], pdf["token"], pdf["told"]):
                node, size, token = np.frombuffer(node, np.int64), np.frombuffer(size, np.int32), np.frombuffer(token, np.uint64)
                value, total = np.frombuffer(b"".join(x["token"] for x in told), np.uint64), np.frombuffer(b"".join(x["n"] for x in told), np.int32)
                order = np.argsort(value)
                value, total = value[order], total[order]
                at = np.minimum(np.searchsorted(value, token), len(value) - 1)
                known = value[at] == token
                token, total, owner = token[known], total[at[known]], np.repeat(np.arange(len(node)), size)[known]
                out = []
                ends = np.cumsum(np.bincount(owner, minlength=len(node))).tolist()
                for k, (i, j) in enumerate(zip([0, *ends], ends)):
                    spare = j - i - int(np.ceil(similarity * size[k] - SLACK))
                    if spare >= 0:
                        own = token[i:j]
                        out.append((int(node[k]), int(size[k]), own[np.lexsort((own, total[i:j]))[: spare + 1]].tobytes(), own.tobytes()))
                yield pd.DataFrame(out, columns=["node", "size", "prefix", "shared"])

    return arrange


def _ordered(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = texts.select("text").mapInPandas(_sets(shingle), "node binary, size binary, token binary").withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks, "blocks")
    asked = blocks.select("block", "token").mapInPandas(_ask(buckets), "bucket int, block long, token binary, n binary")
    answers = asked.repartitionById(buckets, "bucket").select("block", "token", "n").mapInPandas(_answer, "block long, token binary, n binary")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("token", "n")).alias("told"))  # of one batch of texts
    rows = blocks.join(told, "block").select("node", "size", "token", "told").mapInPandas(_arrange(similarity), "node long, size int, prefix binary, shared binary")
    sets = materialize(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("shared").alias("shared")), "sets")
    discard(blocks)
    return sets


# --- 3. candidates


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(token, node, size, rest): ``rest`` shared tokens of the node are not before this one."""
    for pdf in batches:
        if len(pdf):
            token = [np.frombuffer(x, np.int64) for x in pdf["prefix"]]
            n = [len(x) for x in token]
            rest = np.repeat(pdf["n_shared"].values, n) - np.concatenate([np.arange(k) for k in n])
            yield pd.DataFrame({"token": np.concatenate(token), "node": np.repeat(pdf["node"].values, n), "size": np.repeat(pdf["size"].values, n), "rest": rest.astype(np.int32)})


def _fits(similarity: float, n: str, m: str, rest: str, other: str):
    common = F.least(n, m, rest, other)
    return common * (1 + similarity) >= similarity * (F.col(n) + F.col(m)) - SLACK


def _stars(postings: DataFrame, similarity: float) -> DataFrame:
    """Each shingle's first node with its others."""
    hub = postings.groupBy("token").agg(F.min(F.struct("node", "size", "rest")).alias("h"))
    both = postings.join(hub, "token").select(F.col("h.node").alias("a"), F.col("node").alias("b"), "size", F.col("h.size").alias("m"), "rest", F.col("h.rest").alias("other"))
    return both.filter(F.col("a") != F.col("b")).filter(_fits(similarity, "size", "m", "rest", "other")).select("a", "b")


def _whole(batches: Iterator[pd.DataFrame], held: int) -> Iterator[pd.DataFrame]:
    """Sorted batches as larger ones that hold all rows of their groups."""
    key = ["token", "c1", "c2"]
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        rest.append(pdf)
        if sum(map(len, rest)) < held:
            continue
        whole = pd.concat(rest, ignore_index=True)
        last = (whole[key] == whole[key].iloc[-1]).all(axis=1)
        if not last.all():
            yield whole[~last]
        rest = [whole[last]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _pair(similarity: float, held: int):
    """Pairs of different components within a block, or between two blocks, of one shingle's nodes."""

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, held):
            pdf = pdf.sort_values(["token", "c1", "c2", "component", "node"])
            token, c1, c2, c, node, size, rest, component = (pdf[x].values.astype(np.int64) for x in ("token", "c1", "c2", "c", "node", "size", "rest", "component"))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
            group = np.cumsum(new)
            end = np.append(np.flatnonzero(new)[1:], len(token))[group - 1]
            run = np.flatnonzero(new | np.concatenate([[True], component[1:] != component[:-1]]))
            j = np.repeat(np.append(run[1:], len(token)), np.diff(np.append(run, len(token))))  # past those of one's own component
            i, found, n = np.arange(len(token)), [], 0
            while True:
                i, j = i[j < end[i]], j[j < end[i]]
                if not len(i):
                    break
                common = np.minimum(np.minimum(size[i], size[j]), np.minimum(rest[i], rest[j]))
                ok = ((c1[i] == c2[i]) | (c[i] != c[j])) & (common * (1 + similarity) >= similarity * (size[i] + size[j]) - SLACK)
                x, y = node[i[ok]], node[j[ok]]
                found.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}))
                n += len(found[-1])
                if n > PAIRS:
                    yield pd.concat(found).drop_duplicates()
                    found, n = [], 0
                j = j + 1
            if found:
                yield pd.concat(found).drop_duplicates()

    return pair


def _others(postings: DataFrame, components: DataFrame, similarity: float, block: int) -> DataFrame:
    """All other pairs of nodes that share a prefix shingle and are in different components."""
    placed = postings.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token", F.ceil(F.col("n") / block).cast("int").alias("k"))
    placed = placed.join(mixed, "token").withColumn("c", F.pmod(F.xxhash64("component", "node"), F.col("k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("c", o).alias("c1"), F.greatest("c", o).alias("c2")))
    cut = placed.withColumn("cell", F.explode(cells)).select("token", "cell.*", "c", "node", "size", "rest", "component")
    return cut.repartition("token", "c1", "c2").sortWithinPartitions("token", "c1", "c2").mapInPandas(_pair(similarity, 16 * block), "a long, b long")


# --- 4. verify


def _verify(similarity: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y, n in zip(pdf["x"], pdf["y"], (pdf["n"] + pdf["m"]).tolist()):
                both = np.frombuffer(x + y, np.uint64).copy()
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common >= similarity * (n - common) - SLACK)
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    return verify


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = sets.select(F.col("node").alias("a"), F.col("shared").alias("x"), F.col("size").alias("n"))
    y = sets.select(F.col("node").alias("b"), F.col("shared").alias("y"), F.col("size").alias("m"))
    return materialize(pairs.join(y, "b").join(x, "a").mapInPandas(_verify(similarity), "a long, b long"), "links")


def links(docs: DataFrame, marks: DataFrame, shingle: int, similarity: float, propose: Callable[[DataFrame], DataFrame], block: int = BLOCK, extra: float = EXTRA) -> DataFrame:
    """(a, b): keys of different sets, so that the components over these links are those over all similar pairs.

    ``docs`` has ``doc_id`` and ``text``, ``marks`` is ``keys`` of it; ``propose`` takes
    (key, fp) of nodes and gives pairs (a, b) of keys that are worth a look.
    """
    prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    left = _sieve(texts, shingle, similarity, extra)
    nodes = marks.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"))
    nodes = materialize(nodes.join(left, F.col("key") == F.col("node")).select("key", "doc_id", "fp"), "sifted")
    discard(left)
    sets = _ordered(texts.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi"), shingle, similarity)
    postings = sets.select("node", "size", "prefix", (F.octet_length("shared") / 8).cast("int").alias("n_shared")).mapInPandas(_postings, "token long, node long, size int, rest int")
    first = _verified(_stars(postings, similarity).unionAll(propose(nodes.select("key", "fp"))), sets, similarity)
    others = _others(postings, connected_components(first), similarity, block)
    second = _verified(others, sets, similarity)
    discard(sets)
    discard(nodes)
    return first.unionAll(second)
