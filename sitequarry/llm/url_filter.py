"""URL filter: logistic regression on hashed character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

BITS, ORDERS, RIDGE, ROUNDS, THRESHOLD, TRAIN = 16, (3, 4, 5), 1e-4, 500, 0.7, 20_000
_PARTS = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", re.IGNORECASE)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small table that comes with the library: (url, label), label 1 for URLs to leave out (gambling, adult, spam, fraud, malware,
    advertising, piracy), 0 for others of many kinds and languages. Written by hand, one URL a host."""
    with resources.files(__package__).joinpath("url_labels.csv").open(encoding="utf-8", newline="") as f:
        return spark.createDataFrame([(r["url"], int(r["label"])) for r in csv.DictReader(f)], "url string, label int")


def features(url: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed n-grams of the host and the path, ends marked, each as the part's own and as one of either part; scheme, user,
    port, query and fragment don't count."""
    host, path = _PARTS.match(url.strip()).groups()
    grams = {k + t[i : i + n] for kind, t in (("h", f"^{host.lower()}$"), ("p", f"^{path.lower()}$")) for n in ORDERS for i in range(len(t) - n + 1) for k in (kind, "")}
    return np.unique([xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) >> 32 - bits for g in grams]) if grams else np.empty(0, np.int64)


class Model:
    """Ridge-penalised logistic loss by accelerated gradient steps, until the gradient is small."""

    def __init__(self, urls: list[str], labels: list[int], *, bits: int = BITS, ridge: float = RIDGE, rounds: int = ROUNDS):
        self.bits = bits
        x, y = [features(u, bits) for u in urls], (np.array(labels) > 0).astype(float)
        row, feat = np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate(x).astype(np.int64)
        scale = 1 / np.sqrt(np.maximum(1, np.array([len(f) for f in x])))
        weight = len(y) / (2 * np.where(y > 0, max(1, y.sum()), max(1, (1 - y).sum())))
        w = v = np.zeros((1 << bits) + 1)
        rate, k = 2.0, 1.0
        for _ in range(rounds):
            z = np.bincount(row, v[feat] * scale[row], len(y)) + v[-1]
            e = weight * (1 / (1 + np.exp(-z)) - y) / len(y)
            g = np.append(np.bincount(feat, e[row] * scale[row], 1 << bits), e.sum()) + ridge * np.append(v[:-1], 0)
            new, k2 = v - rate * g, (1 + np.sqrt(1 + 4 * k * k)) / 2
            v, w, k = new + (k - 1) / k2 * (new - w), new, k2
            if np.abs(g).max() < 1e-7:
                break
        self.weights, self.bias = w[:-1].astype(np.float32), float(w[-1])

    def probability(self, urls: list[str]) -> np.ndarray:
        x = [features(u, self.bits) for u in urls]
        n = np.array([len(f) for f in x])
        z = np.bincount(np.repeat(np.arange(len(x)), n), self.weights[np.concatenate(x).astype(np.int64)], len(x)) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-(z / np.sqrt(np.maximum(1, n)) + self.bias)))


def train(labelled: DataFrame, *, rows: int = TRAIN) -> Model | None:
    """Fits on at most ``rows`` of the table, drawn by hash of the URL; null URLs and labels don't count. None unless there are both classes."""
    got = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label")).distinct()
    data = sorted((r.url, r.label) for r in got.orderBy(F.xxhash64("url"), "url", "label").limit(rows).collect())
    return Model([u for u, _ in data], [y for _, y in data]) if len({y > 0 for _, y in data}) == 2 else None


def judge(pages: DataFrame, model: Model | None, *, column: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with url_bad (probability) and url_ok (below the threshold), replacing columns of these names.

    A null URL, or a missing model, has a null probability and is not ok; an empty URL has the model's bias. URLs are judged whole,
    whatever they consist of. Other columns and the rows' multiplicity stay; an empty table gives no rows.
    """
    names = ["url_bad", "url_ok"]
    pages = pages.drop(*names)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                urls = batch.column(column).to_pylist()
                none = np.array([u is None or own is None for u in urls])
                p = np.ones(len(urls)) if own is None else own.probability([u or "" for u in urls])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(p, mask=none), pa.array(~none & (p < threshold))], [*batch.schema.names, *names])

    return pages.mapInArrow(run, StructType([*pages.schema, StructField(names[0], DoubleType()), StructField(names[1], BooleanType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), train(labelled_urls(spark)))
