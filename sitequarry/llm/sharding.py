"""Sharding: a Feistel permutation with cycle walking over global row numbers.

The shuffle is a bijection that any machine can compute for any row, in either direction, from the seed and the number of rows:
no random column, and no second shuffle. Row numbers come from one range-partitioned sort, written once, plus the partitions'
offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from .common import Workspace, broadcast_if_small, free_names

SHARDS, SEED, ROUNDS = 64, 2024, 6
_A, _B = 0x7FEB352D, 0x6C62272E
_LOW = 0xFFFFFFFF


def round_keys(seed: int, rounds: int) -> list[int]:
    out, x = [], seed
    for _ in range(rounds):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x >> 33)
    return out


def half_bits(rows: int) -> int:
    """Half the bits of the least square power of four that holds all row numbers."""
    return max(1, ((rows - 1).bit_length() + 1) // 2)


def _f(x: np.ndarray, key: int) -> np.ndarray:
    h = (x * np.uint64(_A) + np.uint64(key)) & np.uint64(_LOW)
    h ^= h >> np.uint64(15)
    h = (h * np.uint64(_B)) & np.uint64(_LOW)
    return h ^ (h >> np.uint64(13))


def _pass(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for k in keys:
        left, right = right, left ^ (_f(right, k) & mask)
    return right << np.uint64(bits) | left


def permute(x: np.ndarray, rows: int, seed: int = SEED, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The row numbers' places (inverse: the places' row numbers), in 0..rows-1. Values outside the range walk on until inside."""
    bits, keys = half_bits(rows), round_keys(seed, rounds)
    x = _pass(np.asarray(x).astype(np.uint64), bits, keys := keys[::-1] if inverse else keys)
    while len(out := np.flatnonzero(x >= np.uint64(rows))):
        x[out] = _pass(x[out], bits, keys)
    return x.astype(np.int64)


def number_rows(ws: Workspace, docs: DataFrame, by: str, kept: list[str], row: str) -> tuple[DataFrame, int]:
    """(the kept columns with ``row`` 0, 1, 2 ... in order of ``by``, nulls first; the number of rows).

    Ties go by a hash of all columns, so that only equal rows can change places.
    """
    tie, number, part, start = free_names(docs, "tie", "number", "part", "start")
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]
    order = docs.select(*{by: 0, **dict.fromkeys(kept)}, F.xxhash64(*plain).alias(tie)).repartitionByRange(F.col(by), F.col(tie)).sortWithinPartitions(by, tie).select(*kept)
    done = ws.table(order.withColumn(number, F.monotonically_increasing_id()), "ordered")
    done = done.withColumn(part, F.shiftright(number, 33))
    offsets, total = [], 0
    for k, n in sorted(tuple(r) for r in done.groupBy(part).count().collect()):
        offsets.append((k, total))
        total += n
    starts = docs.sparkSession.createDataFrame(offsets, f"{part} long, {start} long")
    out = done.join(broadcast_if_small(starts, len(offsets), 32), part)
    return out.withColumn(row, F.col(start) + F.col(number).bitwiseAND((1 << 33) - 1)).drop(part, start, number), total


def shard(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, by: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or these columns of it) with row_number, shard and slot (longs), replacing columns of these names.

    Place p of a row is the permutation of its number; shard = p mod shards, slot = p div shards: shards differ by one row at most,
    and slots of a shard are 0, 1, 2 ... Equal rows are numbered one after another. Null keys come first, ties go by a hash of all
    columns. Null, empty and very long texts and other columns of any names are carried along. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    names = ["row_number", "shard", "slot"]
    docs = docs.drop(*names)
    (row,) = free_names(docs, "row")
    rows, total = number_rows(Workspace(docs.sparkSession, "shard"), docs, by, columns or docs.columns, row)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(row).to_numpy()
            p = permute(n, total, seed)
            kept = [c for c in b.schema.names if c != row]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n), pa.array(p % shards), pa.array(p // shards)], [*kept, *names])

    kept = [f for f in rows.schema if f.name != row]
    return rows.mapInArrow(run, StructType([*kept, *(StructField(n, LongType()) for n in names)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])


def _sql() -> str:
    f = "({r} * %d + {k}) & %d" % (_A, _LOW)

    def passed(source: str, value: str) -> str:
        s = f"SELECT doc_id, row_number, n, bits, {value} >> bits AS l, {value} & ((1::BIGINT << bits) - 1) AS r FROM {source}"
        for k in round_keys(SEED, ROUNDS):
            a = f"SELECT *, {f.format(r='r', k=k)} AS h0 FROM ({s})"
            b = f"SELECT *, (xor(h0, h0 >> 15) * {_B}) & {_LOW} AS h1 FROM ({a})"
            s = f"SELECT doc_id, row_number, n, bits, r AS l, xor(l, xor(h1, h1 >> 13) & ((1::BIGINT << bits) - 1)) AS r FROM ({b})"
        return f"SELECT doc_id, row_number, n, bits, (r << bits) | l AS x FROM ({s})"

    return f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_number, count(*) OVER () AS n FROM documents
), sized AS (
  SELECT *, greatest(1, CAST(ceil(ceil(log2(n)) / 2) AS INTEGER)) AS bits FROM numbered
), walk AS (
  {passed('sized', 'row_number')}
  UNION ALL
  {passed('(SELECT * FROM walk WHERE x >= n)', 'x')}
)
SELECT doc_id, row_number, x % {SHARDS} AS shard, x // {SHARDS} AS slot FROM walk WHERE x < n
"""


SQL = _sql()
