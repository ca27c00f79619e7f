"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash function rotates the unit vector (three rounds of random signs and a fast Hadamard transform) and names the signed axis it
lies closest to; a table joins ``functions`` of them. A vector is stored in its own bucket of each table and looks into that and
the ``probes`` next likely ones. Equal vectors are one from the start. Buckets carry one byte a dimension, enough to pass over unrelated
vectors; a bucket's links are stars, so that many copies cost no more links than copies. Within a connected group of links all
pairs are then decided with the full vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Workspace, binary_rows, connected_components, fixed_rows, key_runs, mix64
from .groups import bucket_links, classes, in_blocks, verified

THRESHOLD, TABLES, FUNCTIONS, PROBES = 0.9, 8, 2, 3
_MARGIN = 0.03  # what one byte a dimension may be wrong by
_DIGEST = 16
#: Numbers of a block of a large group, and of products made at once.
BLOCK_NUMBERS, PRODUCTS = 4_000_000, 4_000_000


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two wide), scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def signs(count: int, width: int) -> np.ndarray:
    return np.random.default_rng(40_009).choice(np.array([-1, 1], np.float32), (count, 3, width))


def bucket_keys(unit: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """(vector, table, 1 + probes) keys: the own bucket first, then those reached by changing one axis, cheapest change first."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width), np.float32)
    x[:, : unit.shape[1]] = unit
    flips = signs(tables * functions, width)
    axes, costs = [], []
    few = min(probes + 1, 2 * width)
    for f in range(tables * functions):
        r = x
        for k in range(3):
            r = fast_hadamard(r * flips[f, k])
        both = np.hstack([r, -r])
        best = np.argsort(-both, axis=1, kind="stable")[:, :few]
        v = np.take_along_axis(both, best, axis=1)
        axes.append(best)
        costs.append((v[:, :1] - v) ** 2)
    axes = np.stack(axes, 1).reshape(len(x), tables, functions, few)
    costs = np.stack(costs, 1).reshape(len(x), tables, functions, few)

    def key(a: np.ndarray) -> np.ndarray:
        h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), a.shape[:2])
        for i in range(functions):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + a[:, :, i].astype(np.uint64))
        return h

    own = axes[..., 0]
    change = costs[..., 1:].reshape(len(x), tables, -1)
    out = [key(own)]
    order = np.argsort(change, axis=2, kind="stable")[:, :, :probes]
    for p in range(order.shape[2]):
        f, k = np.divmod(order[:, :, p], few - 1)
        a = own.copy()
        np.put_along_axis(a, f[..., None], np.take_along_axis(np.take_along_axis(axes, f[..., None, None], 2)[:, :, 0], (k + 1)[..., None], 2), 2)
        out.append(key(a))
    return np.stack(out, 2)


def vectors(table: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, d, v): unit vectors as binary float32 and their 128-bit digests, of rows with an id; null without a finite vector that isn't zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            size = np.array([len(v) if v.is_valid else 0 for v in batch.column("v")], np.int64)
            for width in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == width)
                x = batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                with np.errstate(all="ignore"):
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares don't overflow
                    x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
                for i in np.flatnonzero(np.isfinite(x).all(axis=1)):
                    out[rows[i]] = (x[i] + np.float32(0)).tobytes()  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v and xxhash.xxh3_128_digest(v) for v in out], pa.binary()), pa.array(out, pa.binary())], ["id", "d", "v"])

    own = table.select(F.col(id_column).alias("id"), F.col(column).alias("v")).where("id is not null")
    return own.mapInArrow(run, StructType([own.schema["id"], StructField("d", BinaryType()), StructField("v", BinaryType())]))


def _chunks(batches: Iterable[pa.RecordBatch], tables: int, functions: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, digests, unit vectors) of some vectors of one dimension; vectors of another dimension never meet them."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            raw, d = batch.column("v").to_pylist(), batch.column("d").to_pylist()
            for width in sorted({len(r) for r in raw}):
                rows = [i for i, r in enumerate(raw) if len(r) == width]
                unit = np.frombuffer(b"".join(raw[i] for i in rows), np.float32).reshape(len(rows), -1)
                keys = bucket_keys(unit, tables, functions, probes) ^ mix64(np.array([width], np.uint64))
                yield keys, np.frombuffer(b"".join(d[i] for i in rows), np.uint8).reshape(len(rows), -1), unit


def _stored(vecs: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    """(key, d, own, code): own marks the bucket the vector is stored in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, d, unit in _chunks(batches, tables, functions, probes):
            code = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)
            per = keys.shape[1] * keys.shape[2]
            own = np.zeros(keys.shape, bool)
            own[:, :, 0] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), binary_rows(np.repeat(d, per, axis=0)), pa.array(own.reshape(-1)), binary_rows(np.repeat(code, per, axis=0))], ["key", "d", "own", "code"])

    return vecs.mapInArrow(run, "key long, d binary, own boolean, code binary")


def _bucket_keys(vecs: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, _ in _chunks(batches, tables, functions, probes):
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64))], ["key"])

    return vecs.mapInArrow(run, "key long")


def _joined(x: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Label (the first row) of each row's component; links are those between a row and a stored one. Rows are taken in blocks."""
    label, mine = np.arange(len(x)), np.flatnonzero(own)
    step = max(1, PRODUCTS // max(1, len(mine)))
    for i in range(0, len(x), step):
        hit = x[i : i + step] @ x[mine].T >= least
        for k in np.flatnonzero(hit.any(axis=1)):
            together = np.unique(label[np.append(mine[hit[k]], i + k)])
            if len(together) > 1:
                label[np.isin(label, together)] = together[0]
    return label


def _meetings(rows: DataFrame, least: float) -> DataFrame:
    dealt = "lead" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in key_runs(batches, "key"):
            d, own = fixed_rows(t.column("d"), np.uint8, _DIGEST), t.column("own").to_numpy()
            lead, code = t.column("lead").to_numpy() if dealt else None, t.column("code")
            a, b, strays = [], [], []
            for lo, hi in zip(runs[:-1], runs[1:], strict=True):
                if hi - lo < 2 or not (dealt or own[lo:hi].any()):
                    continue
                x = np.frombuffer(b"".join(code.slice(lo, hi - lo).to_pylist()), np.int8).reshape(hi - lo, -1).astype(np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                label = _joined(x, own[lo:hi], least)
                linked = np.flatnonzero(label != np.arange(hi - lo))
                a.append(lo + label[linked]), b.append(lo + linked)
                if dealt:
                    strays.append(lo + np.flatnonzero(label != label[np.argmax(lead[lo:hi])]))
            a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
            yield pa.RecordBatch.from_arrays([binary_rows(d[a]), binary_rows(d[b])], ["a", "b"])
            if strays and len(s := np.concatenate(strays)):
                yield pa.RecordBatch.from_arrays([binary_rows(d[s]), pa.nulls(len(s), pa.binary())], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def near_duplicates(table: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES) -> DataFrame:
    """A row per vector: its id, class_id, copies, links.

    Two vectors are linked if their cosine is at least ``threshold``. ``class_id`` is the least id of the connected group (the vector's own
    if it is linked with none); ``copies`` counts the rows of the very same direction, itself included; ``links`` the other directions
    that are linked with its own. Every row is a query.

    Rows without an id have no row; a null, empty, zero or non-finite vector (null elements included) is alone, with 1 copy and no link.
    Vectors of different dimensions are not compared. Repeated rows count once; an id with several vectors has a row for each
    different one. Ids may be of any type that has an order. Other columns are ignored. An empty table gives no rows.
    """
    ws = Workspace(table.sparkSession, "embedding-dedup")
    all_ = ws.table(vectors(table, id_column, column), "vectors")
    vecs = ws.table(all_.where("d is not null").select("d", "v").distinct(), "distinct")
    how = (tables, functions, probes)
    met = bucket_links(ws, _stored(vecs, *how), _bucket_keys(vecs, *how), lambda rows: _meetings(rows, threshold - _MARGIN), F.col("own"))
    comp = connected_components(ws, met)
    members = comp.withColumnRenamed("node", "d").join(vecs.withColumnRenamed("v", "payload"), "d")
    held = in_blocks(ws, members, F.length("payload") / 4, BLOCK_NUMBERS)

    def similar(units: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(units), np.float32).reshape(len(units), -1)
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        return hit

    links, group = verified(ws, held, similar)
    ids = all_.select("id", "d").distinct()
    return classes(ws, ids.where("d is not null"), ids.where("d is null"), links, group).withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
