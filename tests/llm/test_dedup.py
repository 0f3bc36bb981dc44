"""SimHash, embeddings and passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from quarrydex.llm import components, embed_dedup, near_copies, simhash, substring
from quarrydex.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def closure(ids, linked):
    """Smallest id reachable from each position."""
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


# --- components


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = closure(range(600), pairs)
    assert {i: found.get(i, i) for i in range(600)} == dict(enumerate(label))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SPLIT.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "ÉA b", "a b c", "a b c a b c a b c", "x " * 500, "A\x85b\xa0c d\x0be", "日本 語 a A"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    words = ["", "a", "abcdefgh", "é" * 40, "x" * 31, "the cat sat"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert [g % 2**64 for g in got] == [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]


def near(rng, n, families):
    out = []
    for _ in range(families):
        x = rng.getrandbits(64)
        for _ in range(n):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << b
            out.append(y)
            x = y if rng.random() < 0.3 else x
    return out


def test_gray_index_against_all_pairs():
    rng = random.Random(3)
    for fps in (near(rng, 30, 40), near(rng, 300, 2), [0, 1, 3, 7, 15, 31], [5], [2**64 - 1, 0]):
        fps = np.array(sorted(set(fps)), np.uint64)
        bucket = np.array([int(f) % 3 for f in fps])
        index = simhash.GrayIndex(fps, bucket)
        label = index.components(3)
        f, b = fps[index.order], bucket[index.order]
        links = [(i, j) for i in range(len(f)) for j in range(i) if b[i] == b[j] and int(f[i] ^ f[j]).bit_count() <= 3]
        assert label.tolist() == closure(range(len(f)), links)


@pytest.mark.parametrize("limit", [1 << 20, 8])
def test_routes_lose_no_link(spark, limit):
    """Also when routes are split again and again."""
    rng = random.Random(5)
    fps = sorted(set(near(rng, 12, 25) + [rng.getrandbits(16) for _ in range(150)]))
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    routed = simhash._routes(nodes, 3, limit).repartition(3, "mask", "value").sortWithinPartitions("mask", "value")
    edges = [(r["a"], r["b"]) for r in routed.mapInPandas(simhash._links(3), "a long, b long").collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in edges)
    expect = closure(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert closure(range(len(fps)), edges) == expect


def test_near_duplicates_edge_cases(spark):
    base = "the quick brown fox jumps over the lazy dog " * 30
    rows = [(1, base, "x"), (2, base, None), (9, base + "end", "x"), (3, None, "x"), (4, "", "x"), (5, "other words that are quite different here", "x"), (6, None, None), (None, base, "x"), (5, "other words that are quite different here", "x"), (7, base.upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs)
    got = sorted((r["doc_id"], r["component_id"]) for r in found.collect() if r["doc_id"] is not None)
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (6, 3), (7, 1), (9, 1)]
    assert [r["component_id"] for r in found.filter("doc_id IS NULL").collect()] == [None]
    kept = simhash.keep_first(docs, found)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 5]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**5)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "A " * 300_000), (4, "a " * 299_000), (5, "\x0b".join(reversed(words)))]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["component_id"] for k in range(1, 6)] == [1, 1, 3, 3, 5] and got[3]["fp"] % 2**64 == xxhash.xxh64(b"a a a", seed=42).intdigest()


def test_op1(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_simhash"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d["text"]) for d in docs]
    label = closure([d["doc_id"] for d in docs], [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [(got[d["doc_id"]]["fingerprint"], got[d["doc_id"]]["component_id"]) for d in docs] == [(f"{f:016x}", x) for f, x in zip(fps, label)]


# --- passages


def brute_passages(docs, window=50):
    words = {(i, t): SPLIT.findall(t or "") for i, t in docs}
    first = {}
    for (i, t), w in words.items():
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words[i, t]
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sample_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 90, 200]))] for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word() for _ in range(rng.randint(0, 60))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        docs.append((i * 3 % n, rng.choice([" ", "\n", "\t "]).join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    docs = sample_texts(seed) + [(70, "same " * 120), (71, "same " * 120), (72, "same " * 55), (73, None), (74, ""), (75, " ".join(f"w{i}" for i in range(49))), (76, " ".join(f"w{i}" for i in range(49)))]
    docs += [(None, docs[5][1]), (None, "same " * 120), docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(df).collect()), key=str)
    assert got == brute_passages(docs)


def test_shards_do_not_matter(spark, monkeypatch):
    docs = sample_texts(4)
    monkeypatch.setattr(substring, "SHARD_WORDS", 50)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute_passages(docs)


def test_automata_find_the_passages(spark, monkeypatch):
    """Without the automata's reports nothing is found; a report names a phrase wherever it stands."""
    words = [b"w%d" % (i % 7) for i in range(80)]
    row = substring.anchors(words, 50, 8)
    automaton = substring.compile_phrases(pd.DataFrame(row, columns=["p", "q"]), 8)
    codes = substring.word_codes(words).tolist()
    phrases = [tuple(c) for c in row.view("<u2").reshape(-1, 8).tolist()]
    assert sorted((e - 7, k) for e, k in automaton.iter(tuple(codes))) == [(i, phrases.index(tuple(codes[i : i + 8]))) for i in range(73) if tuple(codes[i : i + 8]) in phrases]
    docs = spark.createDataFrame(sample_texts(4), "doc_id long, text string")
    assert substring.digest(docs).filter("n_removed > 0").count() > 5

    class Dumb(list):
        def iter(self, codes):
            return []

    monkeypatch.setattr(substring, "compile_phrases", lambda confirmed, phrase: Dumb())
    each, parts = substring.find_repeats(docs)
    assert parts.count() == 0


def test_remove_repeats(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"start\n{long} end", "x"), (2, f"other {long} tail", "y"), (3, long, None), (4, "short  text", "z"), (5, None, "n"), (None, long, "i"), (4, "short  text", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(((r["doc_id"], r["text"], r["kept"]) for r in substring.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, f"start\n{long} end", "x"), (2, "other tail", "y"), (4, "short  text", "z"), (4, "short  text", "z"), (5, None, "n"), (None, long, "i")], key=str)
    assert substring.remove_repeats(docs.limit(0)).count() == 0 and substring.digest(docs.limit(0)).count() == 0


def test_op5(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op5_substring"](spark, DATA).collect()), key=str)
    assert got == brute_passages(docs)


# --- embeddings


def brute_links(rows, threshold=0.93):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    linked = []
    for i, (a, v, x) in enumerate(rows):
        for j in range(i):
            b, w, y = rows[j]
            if x is not None and x == y and a is not None and b is not None and usable(v) and usable(w) and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= threshold:
                    linked.append((i, j))
    return linked


def clusters(rng, groups, size, dim, noise):
    out = []
    for _ in range(groups):
        c = rng.normal(size=dim)
        out += [(c + noise * rng.normal(size=dim)).tolist() for _ in range(size)]
    return out


@pytest.mark.parametrize("functions", [1, 2])
def test_embeddings(spark, monkeypatch, functions):
    """Recall of links is at least 0.9, counts never exceed the truth, copies and odd vectors have their defined results."""
    if functions == 2:
        monkeypatch.setattr(embed_dedup, "BUCKET", 1)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    vectors = clusters(rng, 12, 25, 32, 0.22) + rng.normal(size=(100, 32)).tolist()
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    rows += [(1000 + k, vectors[0], 0) for k in range(5)] + [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] * 32, 0), (2003, vectors[0], None), (2004, [None] * 32, 0), (2005, [1.0] * 16, 0), (2006, [float("inf")] * 32, 1), (None, vectors[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    links = brute_links(rows)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = sum(got[r[0]]["n_links"] for r in rows)
    assert all(got[r[0]]["n_links"] <= degree[k] for k, r in enumerate(rows))
    assert found >= 0.9 * degree.sum() > 0
    for k in range(2000, 2007):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[None]["component_id"] is None and got[None]["n_links"] == 0
    assert all(got[1000 + k]["component_id"] == 0 and not got[1000 + k]["kept"] and got[1000 + k]["n_links"] >= 5 for k in range(5))
    label = closure([r[0] if r[0] is not None else 10**6 for r in rows], links)
    assert np.mean([got[r[0]]["component_id"] == x for r, x in zip(rows, label) if r[0] is not None]) > 0.95


@pytest.mark.parametrize("functions, dim, least", [(1, 64, 0.99), (2, 64, 0.97), (3, 64, 0.96), (4, 64, 0.96), (1, 256, 0.99), (2, 256, 0.97), (3, 256, 0.95), (4, 256, 0.9)])
def test_recall_of_codes(functions, dim, least):
    """Pairs at exactly the limit meet in some table, however long the codes have grown with the rows."""
    rng = np.random.default_rng(functions * dim)
    a, b = rng.normal(size=(2, 600, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    tables = embed_dedup.TABLES + 4 * (functions - 1)
    x, y = (embed_dedup.codes(v, tables, functions, embed_dedup.PROBES) for v in (a, b))
    met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=(1, 2))
    assert met.mean() >= least


def test_embeddings_with_clashing_names(spark):
    rows = [(i, [1.0, float(i % 2), 0.0], "x") for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for c in ("v", "m", "id", "first", "n", "component", "n_links", "kept", "t", "code", "e", "c", "_l"):
        df = df.selectExpr("*", f"'{c}' AS {c}")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (4, i % 2) for i in range(10)}


def test_hadamard():
    h = embed_dedup.hadamard(np.eye(8))
    assert (h @ h.T == 8 * np.eye(8)).all()
    assert embed_dedup.codes(np.eye(3), 2, 1, 3).shape == (3, 2, 3)


def test_op4(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in e]
    links = brute_links(rows)
    got = {r["vec_id"]: r for r in QUERIES["op4_embed_dedup"](spark, DATA).collect()}
    assert len(got) == len(rows) and sum(r["n_links"] for r in got.values()) <= 2 * len(links)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(links)
    assert embed_dedup.near_duplicates(spark.read.parquet(f"{DATA}/embeddings.parquet").limit(0)).count() == 0


def test_similar_texts(spark):
    """Edited copies are found by the similarity of their five-word shingles; unrelated texts stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    rows, expect = [], {}
    for family in range(25):
        base = [word() for _ in range(rng.randint(80, 300))]
        for copy in range(4):
            edited = list(base)
            for _ in range(copy * len(base) // 400):
                edited[rng.randrange(len(edited))] = word()
            rows.append((family * 10 + copy, " ".join(edited)))
            expect[family * 10 + copy] = family * 10
    rows += [(1000, None), (1001, " "), (1002, "two words"), (1003, "Two  words"), (1004, "one"), (None, rows[0][1]), (0, rows[0][1])]
    expect |= {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, 1004: 1004}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit, block in ((1 << 20, 1 << 12), (20, 2)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, route_limit=limit, block=block).collect()}
        assert got.pop(None) is None and got == expect
    assert simhash.similar_texts(docs.limit(0)).count() == 0


def brute_sets(text):
    words = SPLIT.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(rows, similarity=0.8):
    """Component of each (id, text) over all pairs of texts of equal or similar sets."""
    sets = [brute_sets(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0]
    return dict(zip([r[0] for r in rows], closure([r[0] for r in rows], linked)))


@pytest.mark.parametrize("inserted", [False, True])
def test_similar_texts_with_blocks_of_new_words(spark, inserted):
    """Copies with a block of new words appended or inserted are found at every similarity from 0.8 on."""
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = []
    for family in range(60):
        base = [word() for _ in range(rng.choice([100, 200, 400]))]
        share = (0.05, 0.1, 0.15, 0.2)[family % 4]
        at = len(base) // 2 if inserted else len(base)
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(base[:at] + [word() for _ in range(int(share * len(base)))] + base[at:]))]
    expect = brute_similar(rows)
    assert sum(k != c for k, c in expect.items()) >= 45
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expect


@pytest.mark.parametrize(("words", "block"), [(10, 4096), (80, 4096), (600, 4096), (120, 3)])
def test_similar_texts_at_every_length(spark, words, block):
    """Edits of every kind around the limit, a passage that all texts share, a chain; equal to brute force."""
    rng = random.Random(words + block)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(words // 3)]
    rows = []
    for family in range(20):
        base = [word() for _ in range(words)] + passage
        for copy in range(5):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, words // 20))):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = [[word()], [], [edited[at], word()]][rng.randrange(3)]
            rows.append((5 * family + copy, " ".join(edited)))
            base = edited if family % 2 else base
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == brute_similar(rows) and 0 < sum(k != c for k, c in got.items()) < len(got)


def test_join_needs_no_fingerprints(spark):
    """Without a fingerprint link the join finds the same pairs; a very long text and repeats of one word too."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:30_000] + ["new"] * 3_000 + long[30_000:])), (3, " ".join(long[20_000:])), (4, "x " * 50_000), (5, "x " * 9), (6, "a b c d e f"), (7, "a b c d e f g"), (7, "a b c d e f g h"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect = {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()} == expect
    marks = near_copies.keys(docs, 5)
    found = near_copies.links(docs.filter("doc_id < 4"), marks, 5, 0.8, lambda nodes: nodes.selectExpr("key AS a", "key AS b").limit(0))
    assert found.count() == 1


def test_majority():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 1000, 70_000):
        h = rng.integers(0, 2**64, n, np.uint64)
        assert near_copies.majority(h) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > n)
    assert near_copies.majority(np.zeros(0, np.uint64)) == 0
