"""Quality classifier: naive Bayes support vectors.

Indicators of word and sign n-grams are scaled by their log-count ratios between the classes; a linear hinge-loss model is fitted
to them by dual coordinate descent.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import TokenHash, labelled_sample, mix64

TRAIN, BITS, SMOOTH, COST, EPOCHS, BETA, THRESHOLD = 4000, 18, 1.0, 4.0, 30, 0.25, 0.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT = np.uint64(0x51ED270B153F6A29)


def features(texts: list[str | None], hasher: TokenHash, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of the distinct n-grams of 1 and 2 tokens. Case counts. A token that repeats the one before
    makes one feature, whichever token it is."""
    hasher.trim()
    rows, feats = [], []
    for i, t in enumerate(texts):
        if not t or not (tokens := _TOKEN.findall(t)):
            continue
        h = hasher.of(tokens)
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        f = mix64(np.concatenate([h, np.where(h[:-1] == h[1:], _REPEAT, two)]))
        feats.append((f >> np.uint64(64 - bits)).astype(np.int64) | i << bits)
        rows.append(i)
    if not feats:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.sort(np.concatenate(feats))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> bits, both & ((1 << bits) - 1)


def descend(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, width: int, epochs: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, b, alpha) of the least 1/2 (|w|^2 + b^2) + sum(cost * hinge), by dual coordinate descent. ``xs``: places and values of each row."""
    w, b, alpha = np.zeros(width), 0.0, np.zeros(len(xs))
    square = np.array([1.0 + float(v @ v) for _, v in xs])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(xs)):
            f, v = xs[i]
            g = y[i] * (float(w[f] @ v) + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0.0:
                w[f] += d * v
                b += d
                worst = max(worst, abs(d) * square[i] ** 0.5)
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, b, alpha


class Model:
    def __init__(self, texts: list[str], labels: list[int], *, bits: int = BITS, smooth: float = SMOOTH, cost: float = COST, epochs: int = EPOCHS, beta: float = BETA):
        self.bits = bits
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        row, feat = features(texts, TokenHash(), bits)
        p, q = (smooth + np.bincount(feat[y[row] == s], minlength=1 << bits) for s in (1, -1))
        seen = np.bincount(feat, minlength=1 << bits) > 0
        r = np.where(seen, np.log((p / p[seen].sum()) / (q / q[seen].sum())), 0.0) if len(feat) else np.zeros(1 << bits)
        starts = np.searchsorted(row, np.arange(len(texts) + 1))
        balance = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
        xs = []
        for i in range(len(texts)):
            f = feat[starts[i] : starts[i + 1]]
            xs.append((f, r[f] / np.sqrt(max(1, len(f)))))
        w, b, _ = descend(xs, y, balance, 1 << bits, epochs)
        w = beta * np.where(seen, np.abs(w[seen]).mean() if seen.any() else 0.0, 0.0) + (1 - beta) * w  # between naive Bayes and the margin
        self.weights, self.bias = (w * r).astype(np.float32), b * (1 - beta)

    def score(self, texts: list[str | None], hasher: TokenHash) -> np.ndarray:
        row, feat = features(texts, hasher, self.bits)
        n = np.maximum(1, np.bincount(row, minlength=len(texts)))
        return np.bincount(row, self.weights[feat], len(texts)) / np.sqrt(n) + self.bias


def train(docs: DataFrame, labels: DataFrame, *, column: str = "quality", rows: int = TRAIN) -> Model | None:
    """Fits on at most ``rows`` labelled texts, half of each class at most, drawn by hash; None unless there are both classes.

    Of a doc_id with several labels the largest counts; null ids, labels and texts don't.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("y"))
    data = labelled_sample(docs, own, rows // 2)
    return Model([t for t, _ in data], [y for _, y in data]) if len({y for _, y in data}) == 2 else None


def classify(docs: DataFrame, model: Model | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with quality_score (double) and quality_ok (score >= threshold), replacing columns of these names.

    A null text, or a missing model, has a null score and is not ok; a text without tokens has the model's bias. Whole texts count.
    A score of exactly the threshold is ok; equal texts have equal scores. Very long texts are read as wholes. Other columns, whatever
    their names, and the rows' multiplicity stay; an empty table gives no rows.
    """
    names = ["quality_score", "quality_ok"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = shared.value, TokenHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text").to_pylist()
                none = np.array([t is None or own is None for t in texts])
                s = np.zeros(len(texts)) if own is None else own.score(texts, hasher)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(s, mask=none), pa.array(~none & (s >= threshold))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(names[0], DoubleType()), StructField(names[1], BooleanType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", "text"), model).drop("text")
