"""What the training-data operators share: durable intermediate tables, size-checked broadcasts, grouped Arrow streams,
token n-gram hashing and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..operators.graph import connected_components
from ..storage import BROADCAST_BYTES, Workspace, broadcast_if_small, shared_dir

#: Scripts that are written without spaces between words: Thai to Lao, Myanmar, Khmer, kana, ideographs.
_CLOSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_CLOSE}]+|(?!\W)[{_CLOSE}]")

__all__ = [
    "BROADCAST_BYTES", "IdFilter", "TokenHash", "Workspace", "binary_rows", "broadcast_if_small", "connected_components", "fixed_rows", "free_names", "key_runs", "labelled_sample", "lower", "mix64", "rolling", "row_id", "shared_dir", "shingles",
    "word_spans", "words",
]


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup a stream sorted by an integer ``key``: (table of whole groups, start of each group and the end)."""

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts)
        k = t.column(key).to_numpy()
        return t, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield whole([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and last != k[-1]:
            yield whole(held)
            held = [b]
        else:
            held.append(b)
        last = k[-1]
    if held:
        yield whole(held)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def fixed_rows(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """The inverse of ``binary_rows``."""
    parts = [np.frombuffer(b"".join(c.to_pylist()), dtype).reshape(-1, width) for c in column.chunks if len(c)]
    return np.concatenate(parts) if parts else np.empty((0, width), dtype)


def lower(text: str) -> str:
    """Lower case of the same length: a letter whose lower case is several characters stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores, of scripts without spaces single ones; a null text has none."""
    return _WORD.findall(lower(text)) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where ``words`` of the text lie."""
    return [m.span() for m in _WORD.finditer(lower(text))]


class TokenHash(dict):
    """Token -> 64-bit hash, remembered. ``trim`` empties it when it has grown large; the hashes stay the same."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h

    def of(self, tokens: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()


_MUL = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FIN
    x = (x ^ (x >> np.uint64(29))) * _FIN
    return x ^ (x >> np.uint64(32))


def rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n token hashes (none if there are fewer tokens)."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = tokens[:m].copy()
    for i in range(1, n):
        h *= _MUL
        h += tokens[i : i + m]
    return mix64(h + np.uint64(n))


def shingles(tokens: np.ndarray, n: int) -> np.ndarray:
    """``rolling``, but a text of 1 to n-1 tokens has one shingle, itself."""
    return rolling(tokens, min(n, len(tokens))) if len(tokens) else np.empty(0, np.uint64)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` has no column of (names are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_id(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two longs, 128 bits together, that identify a row by these columns; nulls count as values, maps not at all."""
    kinds = {f.name: f.dataType for f in df.schema}
    own = [c for c in columns if not isinstance(kinds[c], MapType)]
    values = [F.col("`" + c.replace("`", "``") + "`") for c in own]
    nulls = F.concat(F.lit(""), *[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return [F.xxhash64(F.lit(seed), nulls, *values) for seed in (0x51ED27, 0x2545F491)]


class IdFilter:
    """A Bloom filter of 128-bit ids, built by a distributed aggregation, ``BITS_EACH`` bits an id and ``BROADCAST_BYTES`` at most: with
    more ids than that it lets more others through, but never stops one of its own."""

    BITS_EACH, HASHES, MOST_BITS = 12, 3, BROADCAST_BYTES * 8

    def __init__(self, ids: DataFrame, rows: int):
        """``ids``: two long columns, of so many rows."""
        self.bits = min(self.MOST_BITS, 1 << max(10, (self.BITS_EACH * rows - 1).bit_length()))
        h, g = (F.col(c) for c in ids.columns)
        at = F.explode(F.array(*[F.pmod(F.xxhash64(h, g, F.lit(k)), F.lit(self.bits)) for k in range(self.HASHES)]))
        words_of = ids.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[words_of.column("w").to_numpy()] = words_of.column("b").to_numpy()

    @classmethod
    def places(cls, h: Column, g: Column) -> list[Column]:
        """What ``holds`` wants, for the ids of a table."""
        return [F.xxhash64(h, g, F.lit(k)) for k in range(cls.HASHES)]

    def holds(self, places: list[np.ndarray]) -> np.ndarray:
        found = np.ones(len(places[0]), bool)
        for p in places:
            p = p & np.int64(self.bits - 1)
            found &= (self.words[p >> 6] >> (p & 63)) & 1 > 0
        return found


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` different labelled texts of each label, in a fixed order. ``labels``: doc_id, y, one row an id.

    At most ``rows`` ids of each label are drawn by hash before anything is joined, and as many texts of theirs by their 128-bit
    identities, so that many texts under one id are no more than one text each under many.
    """

    def first(table: DataFrame, *by: str | Column) -> DataFrame:
        return table.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(*by))).where(F.col("r") <= rows).drop("r")

    drawn = first(labels.where("doc_id is not null and y is not null"), F.xxhash64("doc_id", F.lit(11)), "doc_id")
    classes = labels.select("y").where("y is not null").distinct().count()
    drawn = broadcast_if_small(drawn, rows * classes, 32)
    own = docs.select("doc_id", "text").where("text is not null").join(drawn, "doc_id")
    own = own.select("text", "y", *(c.alias(k) for c, k in zip(row_id(own, ["doc_id", "text"]), "hg", strict=True)))
    few = first(own.select("y", "h", "g").distinct(), "h", "g").select("h", "g")
    got = own.join(broadcast_if_small(few, rows * classes, 32), ["h", "g"]).groupBy("h", "g").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    return [(r.text, r.y) for r in got.orderBy("h", "g").collect()]
