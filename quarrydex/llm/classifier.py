"""Ordinal quality classifier: cumulative-link regression on hashed text.

A document's latent score is the sum of the hashed weights of its distinct features
over the root of their number.  One weight vector is shared by all grades; ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score).  From them
come the expected grade and tail probabilities P(grade >= k) that select documents.

The model is fitted on at most ``SAMPLE`` rated documents and ``SAMPLE_BYTES`` of their
features, drawn by hash of the id; features are made on the executors and only their
numbers reach the driver.  Every document is scored in whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import begin, materialize, prepare

#: Bytes of features that the fit takes at most.
SAMPLE_BYTES = 128 << 20
#: Rated documents that the fit takes at most; hashed features; passes over the sample.
SAMPLE, BITS, PASSES, RATE = 16384, 18, 60, 0.5
#: Documents whose features are laid out at a time in a fit.
BLOCK = 1024
#: Words whose features a worker remembers.
_REMEMBER = 200_000
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 200 if b > 127 else b for b in range(256))


def _hash(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) & ((1 << BITS) - 1)


class Features:
    """Hashed features of texts: words, stems, word shapes, and how a text repeats itself."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        if len(self.known) > _REMEMBER:
            self.known.clear()
        plain = word.lower().strip(b".,;:")
        shape = word[:4].translate(_SHAPE) + b"/" + word[-3:].translate(_SHAPE)
        stem = [b"p" + plain[:5]] if len(plain) > 5 else []
        out = self.known[word] = tuple(_hash(f) for f in (b"w" + plain, b"s" + shape, *stem))
        return out

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        n, distinct = max(1, len(words)), set(words)
        same = sum(map(bytes.__eq__, words, words[1:]))
        found = {_hash(b"#same%d" % min(9, 20 * same // n)), _hash(b"#new%d" % (10 * len(distinct) // n)), _hash(b"#size%d" % len(words).bit_length())}
        known = self.known
        for w in distinct:
            found.update(known.get(w) or self._of_word(w))
        return np.sort(np.fromiter(found, np.int32, len(found)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    """Weights and ascending thresholds; grades are 0 to ``len(thresholds)``."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum(dtype=np.float64) / np.sqrt(len(features) + 1))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 and up, one row a score."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])


def slopes(w: np.ndarray, th: np.ndarray, features: list[np.ndarray], grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of ``grades``, and its slopes in the weights and thresholds."""
    n, cuts = len(features), len(th)
    loss, g, gt = 0.0, np.zeros(len(w)), np.zeros(cuts)
    for at in range(0, n, BLOCK):  # blocks of documents keep the driver's memory small
        part, y = features[at : at + BLOCK], grades[at : at + BLOCK]
        long = np.fromiter(map(len, part), np.int64, len(part))
        row, col, scale = np.repeat(np.arange(len(part)), long), np.concatenate(part), 1 / np.sqrt(long + 1)
        s = np.bincount(row, weights=w[col], minlength=len(part)) * scale
        first, last = y == 0, y == cuts
        lo = np.where(first, 0.0, _sigmoid(th[np.maximum(y - 1, 0)] - s))
        hi = np.where(last, 1.0, _sigmoid(th[np.minimum(y, cuts - 1)] - s))
        p = np.maximum(hi - lo, 1e-9)
        loss -= float(np.log(p).sum()) / n
        dlo, dhi = lo * (1 - lo) * ~first / p, hi * (1 - hi) * ~last / p
        g += np.bincount(col, weights=((dhi - dlo) * scale / n)[row], minlength=len(w))
        gt += [(dlo[y == k + 1].sum() - dhi[y == k].sum()) / n for k in range(cuts)]
    return loss, g, gt


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, passes: int = PASSES, rate: float = RATE) -> OrdinalModel:
    """Maximum likelihood by adaptive gradient steps; without ratings every grade's tail is near one."""
    size, cuts = 1 << BITS, n_grades - 1
    if not len(features):
        return OrdinalModel(np.zeros(size, np.float32), np.full(cuts, -20.0) + np.arange(cuts))
    w, th = np.zeros(size), np.linspace(-2, -1, cuts)
    m, g2, t2 = np.zeros(size), np.full(size, 1e-8), np.full(cuts, 1e-8)
    for step in range(passes):
        _, g, gt = slopes(w, th, features, grades)
        g += 1e-7 * w
        m, g2, t2 = 0.9 * m + 0.1 * g, 0.99 * g2 + 0.01 * g * g, 0.99 * t2 + 0.01 * gt * gt
        pace = rate * (1 - step / passes)
        w -= pace * m / (np.sqrt(g2) + 1e-9)
        th = np.sort(th - 0.5 * pace * gt / (np.sqrt(t2) + 1e-9))
    return OrdinalModel(w.astype(np.float32), th)


def sampled(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_grades: int = 3, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, grade, f) of the rated texts that a fit takes: at most ``sample`` rows and ``sample_bytes`` of features ``f``."""
    prepare(docs.sparkSession)
    graded = ratings.filter(f"grade >= 0 AND grade < {n_grades}").select(F.col(id_col).alias("_id"), F.col("grade").cast("int").alias("grade")).distinct()
    graded = graded.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    chosen = graded.orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "_id")  # at most `sample` rows

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"], "grade": pdf["grade"], "f": [make(t).tobytes() for t in pdf["text"]]})

    rows = texts.mapInPandas(featurize, "id long, grade int, f binary").withColumn("key", F.xxhash64("f")).dropDuplicates(["id", "grade", "key"])
    place = [F.xxhash64("id"), "id", "grade", "key"]
    rows = materialize(rows, "rated")  # several texts of one id are several rows
    first = rows.select("id", "grade", "key", F.octet_length("f").alias("n")).orderBy(*place).limit(sample)
    fits = first.withColumn("upto", F.sum("n").over(Window.orderBy(*place))).filter(F.col("upto") <= sample_bytes).select("id", "grade", "key")  # of `sample` rows at most
    return rows.join(F.broadcast(fits), ["id", "grade", "key"]).select("id", "grade", "f")


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_grades: int = 3, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Fit on ``ratings`` (id, ``grade`` from 0) of documents in ``docs``.

    Ratings that are null, out of range or of no document are passed over; repeated
    rows count once, and an id with several texts or grades counts with each.  Of more
    than ``sample`` rows, or ``sample_bytes`` of features, the ones with the smallest
    hashed ids are taken, whichever the rows' order.
    """
    rows = sampled(docs, ratings, id_col, text_col, n_grades=n_grades, sample=sample, sample_bytes=sample_bytes).toPandas()
    rows = rows.sort_values(["id", "grade", "f"]).reset_index(drop=True)
    return fit([np.frombuffer(f, np.int32) for f in rows["f"]], rows["grade"].to_numpy(np.int64), n_grades)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tails``, the array of P(grade >= 1), P(grade >= 2), ..., and their sum ``expected_grade``; null texts are empty."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("array<double>")
    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin("classifier")
        fitted, make = OrdinalModel(*shared.value), Features()
        for texts in batches:
            s = np.array([fitted.score(make(t)) for t in texts])
            yield pd.Series(list(fitted.tails(s)))

    scored = docs.withColumn("tails", tails(F.col(text_col).cast("binary")))
    return scored.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda a, x: a + x))


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, 1 + F.col("quality")).alias("grade"))


def graded(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_top`` = P(highest grade) and ``kept`` = ``p_top >= least``.

    Columns of these names are replaced; every row gives one row.
    """
    keep = [c for c in docs.columns if c not in ("expected_grade", "p_top", "kept")]
    return _graded(docs, labels, least).select(*[F.col("d")[c].alias(c) for c in keep], "expected_grade", "p_top", "kept")


def select_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose P(highest grade) is at least ``least``."""
    return _graded(docs, labels, least).filter("kept").select(*[F.col("d")[c].alias(c) for c in docs.columns])


def _graded(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    model = train(docs, ratings_of(labels))
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.col("text").alias("_text"))
    out = score(rows, model, text_col="_text").withColumn("p_top", F.element_at("tails", -1))
    return out.select("d", "expected_grade", "p_top", (F.col("p_top") >= least).alias("kept"))
