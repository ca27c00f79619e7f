"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set intersection decides.

Every different n-gram set gets ``trees`` labels of ``depth`` min-hashes. A tree is the trie of all labels in sorted order. Two sets
meet at the longest prefix that their labels share; matched prefixes are shortened step by step, from whole labels to the length
at which a pair just at the threshold still meets with the probability of the target, so that partners are found whatever else is
in the table. Sets that meet and whose independent sketches don't rule the threshold out are linked. Within a connected group of
links all pairs are then decided by exact intersections.

Texts are never shuffled, whatever their number. Copies are one set from the start. A bucket of the forest with very many
different sets is dealt over several tasks, and a large group is verified in pairs of blocks, so that no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import IdFilter, TokenHash, Workspace, binary_rows, connected_components, fixed_rows, free_names, key_runs, mix64, row_id, shingles, words
from .groups import bucket_links, classes, in_blocks, verified

N, THRESHOLD, TREES, DEPTH, SKETCH, TARGET = 3, 0.5, 24, 4, 48, 0.95
#: N-grams of a block of a large group.
BLOCK_GRAMS = 2_000_000
_MARGIN = 3.0  # standard deviations below the threshold that a sketch may say before a pair is passed over
_DIGEST = 16


def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_011)
    return (r.integers(0, 2**32, (count, 1), np.uint32) | np.uint32(1)), r.integers(0, 2**32, (count, 1), np.uint32)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    h = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), block):
        np.minimum(out, (h[i : i + block] * a + b).min(axis=1), out=out)
    return out


def mixed_bytes(minima: np.ndarray) -> np.ndarray:
    """A byte of each minimum that is uniform at any length of text: the minima themselves are small numbers, their top bytes near 0."""
    return (mix64(minima.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def meeting_probability(similarity: float, trees: int, length: int) -> float:
    """That labels of two sets share a prefix of this length in one tree at least."""
    return 1 - (1 - similarity**length) ** trees


def least_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """How far matched prefixes are shortened: the longest at which a pair just at the threshold meets with the target's probability."""
    return next((d for d in range(depth, 1, -1) if meeting_probability(threshold, trees, d) >= target), 1)


def signatures(docs: DataFrame, identity: list[str], n: int, trees: int, depth: int) -> DataFrame:
    """A row per document: its id, the 128-bit identity (h, g) of the row, the digest ``d`` of its n-gram set and their number.

    Documents without a token have a null digest. Labels and sketch come with the first row of each set in a task.
    """
    own = docs.select("doc_id", *(c.alias(k) for c, k in zip(row_id(docs, identity), "hg", strict=True)), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashers(trees * depth + SKETCH)
        hasher, known = TokenHash(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                digests, sizes, labels, sketches = [], [], [], []
                for text in batch.column("text"):
                    hasher.trim()
                    g = np.unique(shingles(hasher.of(words(text.as_py())), n))
                    d = xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None
                    digests.append(d), sizes.append(len(g))
                    if d is None or d in known:
                        labels.append(None), sketches.append(None)
                        continue
                    known.add(d)
                    s = minhash(g, a, b)
                    labels.append(s[: trees * depth].tobytes()), sketches.append(mixed_bytes(s[trees * depth :]).tobytes())
                if len(known) > 1_000_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), batch.column("g"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())],
                    ["doc_id", "h", "g", "d", "n", "labels", "sketch"],
                )

    schema = [docs.schema["doc_id"], *(StructField(c, k) for c, k in zip("hgdn", (LongType(), LongType(), BinaryType(), IntegerType()), strict=True)), StructField("labels", BinaryType()), StructField("sketch", BinaryType())]
    return own.mapInArrow(run, StructType(schema))


def _paths(labels: pa.Array, trees: int, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set and tree: hash of the tree and the first ``length`` steps of the label; the other steps, in the order of bytes."""
    own = fixed_rows(pa.chunked_array([labels]), np.uint32, trees * depth).reshape(-1, trees, depth)
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), own.shape[:2])
    for d in range(length):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + own[:, :, d])
    return key.reshape(-1).view(np.int64), own[:, :, length:].reshape(len(own) * trees, depth - length).astype(">u4")


def _rows(sets: DataFrame, trees: int, depth: int, length: int) -> DataFrame:
    """The forest: a row per set and tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                key, rest = _paths(batch.column("labels"), trees, depth, length)
                sketch = fixed_rows(pa.chunked_array([batch.column("sketch")]), np.uint8, SKETCH)
                d = fixed_rows(pa.chunked_array([batch.column("d")]), np.uint8, _DIGEST)
                yield pa.RecordBatch.from_arrays([pa.array(key), binary_rows(rest), binary_rows(np.repeat(d, trees, axis=0)), binary_rows(np.repeat(sketch, trees, axis=0))], ["key", "rest", "d", "sketch"])

    return sets.select("labels", "d", "sketch").mapInArrow(run, "key long, rest binary, d binary, sketch binary")


def _bucket_keys(sets: DataFrame, trees: int, depth: int, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                yield pa.RecordBatch.from_arrays([pa.array(_paths(whole.column("labels").slice(at, 4096), trees, depth, length)[0])], ["key"])

    return sets.select("labels").mapInArrow(run, "key long")


def _similar(x: np.ndarray, y: np.ndarray, axis: int = -1) -> np.ndarray:
    """Jaccard as sketches of one byte a hash have it."""
    return (np.add.reduce(x == y, axis=axis, dtype=np.uint16) / x.shape[axis] - 1 / 256) / (1 - 1 / 256)


def _link(sketches: np.ndarray, least: float, group: np.ndarray | None = None) -> np.ndarray:
    """Label of each row's component, of rows that are similar enough or of one ``group``. Rows of a component are compared with
    those in none yet only; memory is in proportion to the rows."""
    by_hash, rest = np.ascontiguousarray(sketches.T), np.arange(len(sketches))
    group = rest if group is None else group
    label = group.copy()
    while len(rest) > 1:
        root = group[rest[0]]
        mine = group[rest] == root
        front, rest = rest[mine].tolist(), rest[~mine]
        while front and len(rest):
            near = _similar(by_hash[:, rest], by_hash[:, front.pop(), None], axis=0) >= least
            if near.any():
                hit = np.isin(group[rest], group[rest[near]])
                label[rest[hit]] = root
                front += rest[hit].tolist()
                rest = rest[~hit]
    return label


def _descend(sketch: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Components of a sorted bucket: rows of equal labels first, then of prefixes one step shorter each time, down to the bucket."""
    label = np.arange(len(sketch))
    for steps in range(rest.shape[1], -1, -1):
        cut = np.flatnonzero((rest[1:, :steps] != rest[:-1, :steps]).any(axis=1)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(sketch)], strict=True):
            if hi - lo > 1 and (label[lo:hi] != label[lo]).any():
                label[lo:hi] = _link(sketch[lo:hi], least, label[lo:hi])
    return label


def _meetings(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the sets of each bucket, in stars. In a bucket that is dealt over tasks (column ``lead``) a row of
    null ``b`` tells of a set that has no part in the component of the bucket's leader."""
    dealt = "lead" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in key_runs(batches, "key"):
            size = np.diff(runs)
            if not (size > 1).any():
                continue
            kept = pa.array(np.flatnonzero(np.repeat(size > 1, size)))
            d, sketch = (fixed_rows(t.column(c).take(kept), np.uint8, w) for c, w in (("d", _DIGEST), ("sketch", SKETCH)))
            steps = len(t.column("rest")[0].as_py()) // 4
            rest = fixed_rows(t.column("rest").take(kept), np.uint32, steps) if steps else np.empty((len(d), 0), np.uint32)
            lead = t.column("lead").take(kept).to_numpy() if dealt else None
            starts = np.concatenate([[0], np.cumsum(size[size > 1])])
            two = starts[:-1][np.diff(starts) == 2] if not dealt else np.empty(0, np.int64)
            two = two[_similar(sketch[two], sketch[two + 1]) >= least]
            a, b, strays = [two], [two + 1], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if dealt or hi - lo > 2:
                    label = _descend(sketch[lo:hi], rest[lo:hi], least)
                    a.append(lo + label)
                    b.append(np.arange(lo, hi))
                    if dealt:
                        strays.append(lo + np.flatnonzero(label != label[np.argmax(lead[lo:hi])]))
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([binary_rows(d[a]), binary_rows(d[b])], ["a", "b"])
            if dealt and len(s := np.concatenate(strays)):
                yield pa.RecordBatch.from_arrays([binary_rows(d[s]), pa.nulls(len(s), pa.binary())], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(run, "a binary, b binary")


def _shared(sets: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """Sizes of all intersections. N-grams of many sets are counted by a product of presence matrices, those of few by their pairs."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    out = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), sizes)
    _, gram, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(gram, kind="stable")
    posting, start, edge = owner[order], np.cumsum(df) - df, max(8, 0.08 * m)
    flat = out.reshape(-1)
    for f in np.unique(df[(df > 1) & (df < edge)]):
        at = posting[start[df == f][:, None] + np.arange(f)]
        for lo in range(0, len(at), max(1, 2_000_000 // (f * f))):
            p = at[lo : lo + max(1, 2_000_000 // (f * f))]
            np.add.at(flat, (p[:, :, None] * m + p[:, None, :]).reshape(-1), 1)
    heavy = np.flatnonzero(df >= edge)
    for lo in range(0, len(heavy), most):
        own = heavy[lo : lo + most]
        x = np.zeros((m, len(own)), np.float32)
        n = df[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x[posting[at], np.repeat(np.arange(len(own)), n)] = 1
        out += x @ x.T
    return out


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets have a Jaccard of at least ``threshold``, as a matrix (nothing is similar to itself)."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        x = len(np.intersect1d(*sets, assume_unique=True))
        hit = np.array([[False, True], [True, False]]) & (x >= threshold * (sizes.sum() - x))
    else:
        x = _shared(sets)
        hit = x / (sizes[:, None] + sizes[None] - x) >= threshold
        np.fill_diagonal(hit, False)
    return hit


def _verified(ws: Workspace, docs: DataFrame, sets: DataFrame, comp: DataFrame, identity: list[str], n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((d, links): how many other sets each is similar to; (d, root): the connected group of each that is similar to any).

    N-gram sets are made again from one document of each set, found by a Bloom filter of their ids while the texts are read.
    """
    own = ws.table(comp.withColumnRenamed("node", "d").join(sets.select("d", "n", "h", "g"), "d"), "members")
    own = in_blocks(ws, own, F.col("n"), BLOCK_GRAMS)
    shared = docs.sparkSession.sparkContext.broadcast(IdFilter(own.select("h", "g"), own.count()))

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = TokenHash(), set()
        for whole in batches:
            places = [whole.column(f"p{k}").to_numpy() for k in range(IdFilter.HASHES)]
            kept = np.flatnonzero(shared.value.holds(places))
            for at in range(0, len(kept), 256):
                batch = whole.take(pa.array(kept[at : at + 256]))
                ids = list(zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), strict=True))
                fresh = []
                for i, x in enumerate(ids):
                    if x not in known:
                        known.add(x)
                        fresh.append(i)
                if len(known) > 1_000_000:
                    known.clear()
                hasher.trim()
                batch = batch.take(pa.array(fresh, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), pa.array([np.unique(shingles(hasher.of(words(t.as_py())), n)).tobytes() for t in batch.column("text")], pa.binary())], ["h", "g", "payload"])

    texts = docs.select(*(c.alias(k) for c, k in zip(row_id(docs, identity), "hg", strict=True)), "text")
    texts = texts.select("h", "g", *(c.alias(f"p{k}") for k, c in enumerate(IdFilter.places(F.col("h"), F.col("g")))), "text")
    held = own.join(texts.mapInArrow(grams, "h long, g long, payload binary"), ["h", "g"])
    return verified(ws, held, lambda grams: similar_pairs([np.frombuffer(g, np.uint64) for g in grams], threshold))


def similarity_groups(ws: Workspace, docs: DataFrame, identity: list[str], n: int, threshold: float, trees: int, depth: int, target: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, (d, links), (d, root)): see ``signatures`` and ``_verified``."""
    sigs = ws.table(signatures(docs, identity, n, trees, depth), "signatures")
    sets = ws.table(sigs.where("labels is not null").select("d", "n", "h", "g", "labels", "sketch").dropDuplicates(["d"]), "sets")
    least = threshold - _MARGIN * (threshold * (1 - threshold) / SKETCH) ** 0.5
    how = (trees, depth, least_length(threshold, trees, depth, target))
    met = bucket_links(ws, _rows(sets, *how), _bucket_keys(sets, *how), lambda rows: _meetings(rows, least))
    comp = ws.table(connected_components(ws, met), "components")
    ws.drop("met")
    return sigs, *_verified(ws, docs, sets, comp, identity, n, threshold)


def ngram_jaccard_join(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """A row per document: doc_id, class_id, copies, links.

    Two documents are linked if their sets of word n-grams have a Jaccard of at least ``threshold``. ``class_id`` is the least doc_id of
    the connected group (the document's own if it is linked with none); ``copies`` counts the documents of the very same set, itself
    included; ``links`` the other sets that are linked with its set.

    Tokens are lower-case ``\\w+`` runs of whole texts, however long; a text of fewer than n tokens is one gram. A text without a token
    (null, empty) is alone in its class, with 1 copy and no link. Rows of null doc_id have no part in anything and no row. Repeated
    rows count once. Different texts under one doc_id have a row for each different set, in the class of that set. doc_id may be of
    any type that has an order. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    sigs, links, group = similarity_groups(ws, docs, ["doc_id", "text"], n, threshold, trees, depth, target)
    ids = sigs.select(F.col("doc_id").alias("id"), "d").distinct()
    return classes(ws, ids.where("d is not null"), ids.where("d is null"), links, group).withColumnRenamed("id", "doc_id")


def drop_near_duplicates(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """``docs`` with one document of each connected group of the join: the one of the least doc_id (null last, then by a hash of the row).

    All columns are kept as they are, whatever their names. Documents without a token (null, empty) stay, of rows that are equal in
    all columns (maps don't count) one. Very long texts are compared as wholes. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "ngram-dedup")
    sigs, _, group = similarity_groups(ws, docs, docs.columns, n, threshold, trees, depth, target)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g")
    rows = sigs.groupBy("h", "g", "doc_id", "d").agg(F.count("*").alias("rows"))
    rows = ws.table(rows.join(group, "d", "left").withColumn("root", F.coalesce("root", "d")), "rows")
    ws.drop("signatures")
    best = rows.where("root is not null").groupBy("root").agg(F.count("*").alias("of"), F.min(rank).alias("best")).where("of > 1")
    judged = rows.join(best, "root", "left").select("h", "g", (F.col("best").isNull() | ((F.col("best.h") == F.col("h")) & (F.col("best.g") == F.col("g")))).alias("kept"), "rows")
    judged = ws.table(judged, "judged")
    return judged_rows(ws, docs, judged)


def judged_rows(ws: Workspace, docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. ``judged``: (h, g, kept, rows) of every row's identity over all columns.

    Texts stay where they are: a chain of Bloom filters says exactly which rows go (one of the rows that go, one of those kept
    that the first holds, one of those that go that the second holds, and so on, until none is left). If so many rows go that the
    first would be too large to send (134 million), the ids are joined to the rows instead, with one shuffle. Of equal rows, those
    of a task are one at once; the rest of them are brought together.
    """
    h, g, *places, repeated = free_names(docs, "h", "g", *(f"p{k}" for k in range(IdFilter.HASHES)), "repeated")
    asked = docs.select("*", *(c.alias(k) for c, k in zip(row_id(docs, docs.columns), (h, g), strict=True)))
    columns, twice = docs.columns, judged.where("kept and rows > 1").select("h", "g")
    many = twice.count()
    chain = _chain(ws, judged)
    if chain is None:
        gone = judged.where("not kept").select(F.col("h").alias(h), F.col("g").alias(g))
        kept = asked.join(gone, [h, g], "left_anti")
        return (kept.dropDuplicates([h, g]) if many else kept).select(*docs.columns)
    filters = docs.sparkSession.sparkContext.broadcast((chain, IdFilter(twice, many) if many else None))
    asked = asked.select("*", *(c.alias(k) for c, k in zip(IdFilter.places(F.col(h), F.col(g)), places, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, twice = filters.value
        known: set[tuple[int, int]] = set()
        for b in batches:
            at = [b.column(p).to_numpy() for p in places]
            gone, still = np.zeros(b.num_rows, bool), np.ones(b.num_rows, bool)
            for k, f in enumerate(chain):
                still &= f.holds(at)
                gone[still] = k % 2 == 0
            kept = ~gone
            again = twice.holds(at) & kept if twice else np.zeros(b.num_rows, bool)
            for i in np.flatnonzero(again):
                x = (b.column(h)[int(i)].as_py(), b.column(g)[int(i)].as_py())
                if x in known:
                    kept[i] = False
                elif len(known) < 1_000_000:
                    known.add(x)
            own = [*columns, h, g] if many else columns
            out = [b.column(c) for c in own] + ([pa.array(again)] if many else [])
            yield pa.RecordBatch.from_arrays(out, [*own, repeated][: len(out)]).filter(pa.array(kept))

    if not many:
        return asked.mapInArrow(run, docs.schema)
    out = asked.mapInArrow(run, StructType([*docs.schema, StructField(h, LongType()), StructField(g, LongType()), StructField(repeated, BooleanType())]))
    return out.where(~F.col(repeated)).select(*docs.columns).unionByName(out.where(F.col(repeated)).dropDuplicates([h, g]).select(*docs.columns))


def _chain(ws: Workspace, judged: DataFrame) -> list[IdFilter] | None:
    chain: list[IdFilter] = []
    now, against = judged.where("not kept").select("h", "g"), judged.where("kept").select("h", "g")
    while count := now.count():
        if 4 * count > IdFilter.MOST_BITS:
            return None
        chain.append(IdFilter(now, count))
        shared = judged.sparkSession.sparkContext.broadcast(chain[-1])

        def held(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = shared.value.holds([b.column(f"p{k}").to_numpy() for k in range(IdFilter.HASHES)])
                yield pa.RecordBatch.from_arrays([b.column("h"), b.column("g")], ["h", "g"]).filter(pa.array(hit))

        asked = against.select("h", "g", *(c.alias(f"p{k}") for k, c in enumerate(IdFilter.places(F.col("h"), F.col("g")))))
        now, against = ws.table(asked.mapInArrow(held, "h long, g long"), f"held-{len(chain)}"), now
        shared.unpersist()
    return chain


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
