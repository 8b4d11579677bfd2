"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - score), with one weight vector for all thresholds. Features are words and word beginnings
of a text, as log(1 + count). Fitting uses at most about `sample_rows` labelled rows, drawn by a hash of their ids: their feature
counts are added up by Spark, the `n_features` with the strongest log-odds are kept, and the driver fits the weights on that
bounded, sparse sample. Every document is then graded whole, on the executors.

Only the labels' own levels are learned: a threshold below each level that rows have. Where labels have fewer levels than `grades`
(toxic or not teaches one threshold), the thresholds above the last learned one cut the scores of the labelled rows of the highest
level into equal parts, so that grades above it say how far up a text is among those, and are no classes of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 20_000
N_FEATURES = 4096
GRADES = 4
STARTS = (5, 6, 7, 8)
#: Thresholds that aren't learned stand at least so far apart.
GAP = 0.5
#: ASCII upper case to lower case, and ASCII other than letters to blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features_of(word: bytes) -> list[bytes]:
    """A word's features: itself and its beginnings, marked by a star."""
    return [word, *(word[:k] + b"*" for k in STARTS if len(word) >= k)]


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


class Model:
    """Weights of known features, and the ordered thresholds."""

    def __init__(self, features: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.index = {f: k for k, f in enumerate(features)}
        self.weights, self.thresholds = weights, thresholds
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.index, self.weights, self.thresholds

    def __setstate__(self, state):
        self.index, self.weights, self.thresholds = state
        self.cache = {}

    def counts(self, raw: bytes) -> Counter[int]:
        """How often each known feature occurs."""
        found: Counter[int] = Counter()
        for word, n in Counter(words_of(raw)).items():
            ids = self.cache.get(word)
            if ids is None:
                if len(self.cache) > 300_000:
                    self.cache = {}
                ids = self.cache[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            for k in ids:
                found[k] += n
        return found

    def grades(self, raw: bytes) -> np.ndarray:
        """P(grade > k) for each threshold."""
        found = self.counts(raw)
        at = np.fromiter(found.keys(), np.int64, len(found))
        score = float(np.log1p(np.fromiter(found.values(), np.float64, len(found))) @ self.weights[at]) if len(at) else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, n_features: int, grades: int, ridge: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood. rows, cols, x: the sparse features; y: grades from 0."""
    n = len(y)
    first, gaps = np.log((y <= 0).mean() / max(1 - (y <= 0).mean(), 1e-6) + 1e-6), np.zeros(grades - 2)
    at = np.concatenate([np.zeros(n_features), [first], gaps])
    m, v = np.zeros_like(at), np.zeros_like(at)

    def thresholds(a: np.ndarray) -> np.ndarray:
        return np.concatenate([[a[n_features]], a[n_features] + np.cumsum(np.exp(a[n_features + 1 :]))])

    for t in range(1, rounds + 1):
        w, theta = at[:n_features], thresholds(at)
        score = np.bincount(rows, x * w[cols], n)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -50, 50)))  # P(y <= k)
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        hi, lo = full[np.arange(n), y + 1], full[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = (d_hi - d_lo) / n  # of the negative log likelihood
        d_theta = np.zeros(grades - 1)
        top, low = y < grades - 1, y > 0
        np.add.at(d_theta, y[top], -d_hi[top] / n)
        np.add.at(d_theta, y[low] - 1, d_lo[low] / n)
        d_gaps = np.array([d_theta[k + 1 :].sum() * np.exp(at[n_features + 1 + k]) for k in range(grades - 2)])
        slope = np.concatenate([np.bincount(cols, x * d_score[rows], n_features) + ridge * w, [d_theta.sum()], d_gaps])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        at = at - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return at[:n_features], thresholds(at)


def draw_labelled(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, sample_rows: int) -> DataFrame:
    """(text bytes, label) of at most about sample_rows labelled documents, the same in each run."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = marks.count()
    share = min(1.0, sample_rows / max(n, 1))
    some = marks.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)).select(F.col("doc_id").alias("_id"), "label")
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), common.utf8(F.col(text)).alias("text"))
    # the side that is broadcast has about sample_rows rows of two numbers, whatever the corpus
    return common.materialise(rows.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("_doc", "text", "label"), "labelled")


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", grades: int = GRADES, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES) -> Model:
    """The model; labels are levels from 0 up, those from grades - 1 on count as one. Without labels of both kinds it finds nothing toxic."""
    common.ready(docs.sparkSession)
    rows = draw_labelled(docs, labels, doc_id=doc_id, text=text, label=label, sample_rows=sample_rows)
    schema = pa.schema([("feature", pa.binary()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()
        for batch in batches:
            for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y > 0].update({f for w in set(words_of(raw)) for f in features_of(w)})
        keys = list(seen[0] | seen[1])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[0][k] for k in keys]), pa.array([seen[1][k] for k in keys])], schema=schema)

    sizes = {r[0]: r[1] for r in rows.groupBy((F.col("label") > 0).alias("bad")).count().collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        return Model([], np.zeros(0), np.full(grades - 1, 50.0))
    table = rows.select("text", "label").mapInArrow(count, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).filter("a + b >= 3")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(b / (n1 + 1.0 - b)) - F.log(a / (n0 + 1.0 - a))
    spread = F.sqrt(1 / a + 1 / b + 1 / (n0 + 1.0 - a) + 1 / (n1 + 1.0 - b))
    strong = table.orderBy(F.abs(odds / spread).desc(), "feature").limit(n_features).select("feature").collect()
    model = Model([bytes(r[0]) for r in strong], np.zeros(len(strong)), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sparse = pa.schema([("label", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def vector(batch: pa.RecordBatch) -> Iterator[tuple]:
        for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = shared.value.counts(raw)
            yield y, list(found), list(found.values())

    found = rows.orderBy("_doc").select("text", "label").mapInArrow(common.arrow_rows(vector, sparse), "label int, ids array<int>, counts array<int>").toArrow()
    y = found["label"].to_numpy().astype(np.int64)
    lists = found["ids"].combine_chunks()
    cols = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    counts = found["counts"].combine_chunks().flatten().to_numpy().astype(np.float64)
    y = np.minimum(y, grades - 1)
    levels = int(y.max()) + 1
    weights, thresholds = fit_ordinal(row, cols, np.log1p(counts), y, len(strong), levels)
    top = np.bincount(row, np.log1p(counts) * weights[cols], len(y))[y == levels - 1]
    more = np.quantile(top, np.arange(1, grades - levels + 1) / (grades - levels + 1)) if grades > levels else np.zeros(0)
    thresholds = np.concatenate([thresholds, np.maximum.accumulate(np.maximum(more, thresholds[-1] + GAP * np.arange(1, len(more) + 1)))])
    return Model([bytes(r[0]) for r in strong], weights, thresholds)


def severity(spark, model: Model, text: Column) -> Column:
    """A struct (expected, p_toxic, grade) for each text: expected severity, P(grade > 0), most likely grade."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("expected", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])

    def judge(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            for raw in texts.slice(at, 256).to_pylist():
                above = shared.value.grades(raw)
                each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                out.append({"expected": float(above.sum()), "p_toxic": float(above[0]), "grade": int(each.argmax())})
        return pa.array(out, type=kind)

    return F.arrow_udf(judge, "struct<expected: double, p_toxic: double, grade: int>")(common.utf8(text))


def grade_documents(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5, **options) -> DataFrame:
    """(doc_id, severity, grade, toxic) for each row; toxic if P(grade > 0) reaches `least`. Null and empty texts have no features."""
    model = train(docs, labels, doc_id=doc_id, text=text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), severity(docs.sparkSession, model, F.col(text)).alias("s"))
    return rows.select("doc_id", F.col("s.expected").alias("severity"), "s.grade", (F.col("s.p_toxic") >= least).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", least: float = 0.5, **options) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    model = train(docs, labels, text=text, **options)
    s = common.fresh(docs, "_s")
    return docs.withColumn(s, severity(docs.sparkSession, model, F.col(text))).filter(F.col(s)["p_toxic"] < least).drop(s)
