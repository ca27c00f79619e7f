"""Benchmark decontamination: a broadcast hash set of the test items' normalised n-grams, against every token window.

One pass over the documents, without a shuffle. If the set is too large to broadcast, that pass compares with a Bloom filter of the
n-grams, and only the windows that it lets through are joined to them; texts move only of documents that are hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import BROADCAST_BYTES, IdFilter, TokenHash, Workspace, free_names, rolling, row_id, word_spans, words

N, SHORTEST, DROP_SHARE = 8, 5, 0.5
_GRAM_BYTES = 200  # of a broadcast n-gram, besides its text


def benchmark_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (hash, gram, length) of the items; an item of less than n tokens is one gram, one without a token none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHash()
        for batch in batches:
            h, g, k = [], [], []
            for text in batch.column("text"):
                hasher.trim()
                w = words(text.as_py())
                if m := min(n, len(w)):
                    h.append(rolling(hasher.of(w), m).view(np.int64))
                    g += [" ".join(w[i : i + m]) for i in range(len(w) - m + 1)]
                    k += [m] * (len(w) - m + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h) if h else [], pa.int64()), pa.array(g, pa.string()), pa.array(k, pa.int32())], ["hash", "gram", "length"])

    return benchmark.select("text").mapInArrow(run, "hash long, gram string, length int").distinct()


def split_lines(text: str | None, shortest: int, short: bool) -> tuple[list[str], list[tuple[int, int]]]:
    """(tokens of a text, where its lines of less than ``shortest`` tokens lie; these only if asked for)."""
    if not short or not text:
        return words(text), []
    tokens, lines = [], []
    for line in text.split("\n"):
        w = words(line)
        if 0 < len(w) < shortest:
            lines.append((len(tokens), len(tokens) + len(w)))
        tokens += w
    return tokens, lines


class GramSet:
    """N-grams by length; ``hits`` gives the token intervals of a chunk of texts that are one of them. N-grams of less than
    ``shortest`` tokens are looked for among lines."""

    def __init__(self, rows: list, shortest: int):
        self.grams: dict[int, dict[int, set[str]]] = {}
        self.shortest, self.short = shortest, {g for _, g, k in rows if k < shortest}
        for h, g, k in rows:
            if k >= shortest:
                self.grams.setdefault(k, {}).setdefault(h % 2**64, set()).add(g)
        self.vocabulary = {w for _, g, k in rows if k >= shortest for w in g.split(" ")}

    def start(self) -> None:
        self.sorted = {k: np.sort(np.fromiter(g, np.uint64, len(g))) for k, g in self.grams.items()}
        self.tokens = _Known(self.vocabulary)

    def hits(self, raw: list[str | None]) -> dict[int, list[tuple[int, int]]]:
        """By index of the text: verified token intervals, in order, overlapping ones merged."""
        self.tokens.trim()
        found: dict[int, list[tuple[int, int]]] = {}
        texts = []
        for i, t in enumerate(raw):
            tokens, lines = split_lines(t, self.shortest, bool(self.short))
            texts.append(tokens)
            if own := [(lo, hi) for lo, hi in lines if " ".join(tokens[lo:hi]) in self.short]:
                found[i] = own
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        for t, end in zip(texts, ends, strict=True):
            flat[end - 1 - len(t) : end - 1] = np.fromiter(map(self.tokens.__getitem__, t), np.uint64, len(t))
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        for k, known in self.sorted.items():
            at = np.flatnonzero(unknown[k:] == unknown[:-k]) if len(flat) >= k else np.empty(0, np.int64)
            if len(at):
                h = rolling(flat, k)[at]
                there = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for p, x in zip(at[known[there] == h], h[known[there] == h], strict=True):
                    i = int(np.searchsorted(ends, p, side="right"))
                    lo = int(p - (ends[i] - 1 - sizes[i]))
                    if " ".join(texts[i][lo : lo + k]) in self.grams[k][int(x)]:
                        found.setdefault(i, []).append((lo, lo + k))
        return {i: merge(v) for i, v in found.items()}


class _Known(TokenHash):
    """Hashes of the vocabulary; 0 for any other token."""

    def __init__(self, vocabulary: set[str]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if token in self.vocabulary:
            return super().__missing__(token)
        self[token] = 0
        return 0


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: str, intervals: list[tuple[int, int]]) -> str:
    """The text without the intervals of its tokens; a single space stands where something remains on both sides."""
    spans, parts, at = word_spans(text), [], 0
    for lo, hi in intervals:
        parts.append(text[at : spans[lo][0]])
        at = spans[hi - 1][1]
    parts.append(text[at:])
    return " ".join(x for p in parts if (x := p.strip()))


def clean(text: str, first: list[tuple[int, int]], grams: GramSet, drop_share: float) -> tuple[str | None, int]:
    """(text without hits or None if it goes as a whole, tokens removed)."""
    tokens, gone = words(text), 0
    total, hits = len(tokens), first
    while hits:
        gone += sum(hi - lo for lo, hi in hits)
        if gone >= drop_share * total:
            return None, gone
        text = cut(text, hits)
        hits = grams.hits([text]).get(0, [])  # what a cut brings together is looked at again
    return text, gone


def _chunks(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, part.column("text").to_pylist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = N, shortest: int = SHORTEST, drop_share: float = DROP_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the benchmark's passages, in the same columns.

    Tokens are lower-case ``\\w+`` runs, and single characters in scripts without spaces, so that case, punctuation and spacing don't
    matter. Tokens covered by a window of n that also occurs in an item are removed, of whole texts, however long; an item of less
    than n tokens is one window, and one of less than ``shortest`` tokens, which may be common words, is removed where it makes a whole
    line. What a removal brings together is looked at again. A document of which at least ``drop_share`` of the tokens go is removed
    as a whole (exactly that share included). ``n_chars``, if there, is set to the new length. Documents without a hit, of null or empty
    text included, stay byte for byte; repeated rows are treated alike; other columns may have any names; an empty benchmark removes
    nothing; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    grams = ws.table(benchmark_grams(benchmark, n), "grams")
    count, size = grams.agg(F.count("*"), F.sum(F.length("gram") + _GRAM_BYTES)).first()
    if not count:
        return docs
    if size > broadcast_bytes:
        return _joined(ws, docs, grams, count, shortest, drop_share)
    shared = docs.sparkSession.sparkContext.broadcast(GramSet([tuple(r) for r in grams.collect()], shortest))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own := shared.value).start()
        for whole in batches:
            for batch, texts in _chunks(whole):
                hits = own.hits(texts)
                yield _apply(batch, {i: clean(texts[i], hits[i], own, drop_share)[0] for i in hits})

    return docs.mapInArrow(run, docs.schema)


def _apply(batch: pa.RecordBatch, new: dict[int, str | None]) -> pa.RecordBatch:
    if not new:
        return batch
    columns = {name: batch.column(name) for name in batch.schema.names}
    texts = columns["text"].to_pylist()
    for i, t in new.items():
        texts[i] = t
    columns["text"] = pa.array(texts, columns["text"].type)
    if "n_chars" in columns:
        chars = columns["n_chars"].to_pylist()
        for i, t in new.items():
            chars[i] = len(t or "")
        columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
    keep = np.ones(batch.num_rows, bool)
    keep[[i for i, t in new.items() if t is None]] = False
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(keep))


def _places(windows: np.ndarray) -> list[np.ndarray]:
    return [((windows ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)).view(np.int64) for k in range(IdFilter.HASHES)]


class _WindowFilter(IdFilter):
    """A Bloom filter of window hashes."""

    def __init__(self, grams: DataFrame, rows: int):
        self.bits = min(self.MOST_BITS, 1 << max(10, (self.BITS_EACH * rows - 1).bit_length()))

        def run(batches: Iterable[pa.RecordBatch], bits: int = self.bits) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = np.unique(np.concatenate([x & np.int64(bits - 1) for x in _places(b.column("hash").to_numpy().view(np.uint64))]))
                word = np.unique(p >> 6)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (p & 63), np.searchsorted(p >> 6, word)) if len(p) else p)], ["w", "b"])

        t = grams.select("hash").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[t.column("w").to_numpy()] = t.column("b").to_numpy()


def _joined(ws: Workspace, docs: DataFrame, grams: DataFrame, count: int, shortest: int, drop_share: float) -> DataFrame:
    """The same with a set of any size. A turn finds the windows that the filter lets through, joins them to the n-grams, word for
    word, and cuts the texts that are hit; only these go into the next turn, until no text is hit."""
    sc = docs.sparkSession.sparkContext
    lengths = [r.length for r in grams.select("length").distinct().collect()]
    shared = sc.broadcast(_WindowFilter(grams, count))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHash()
        for whole in batches:
            for batch, texts in _chunks(whole):
                hasher.trim()
                row, at, size, hashes, text = [], [], [], [], []
                for i, t in enumerate(texts):
                    tokens, lines = split_lines(t, shortest, min(lengths) < shortest)
                    known = hasher.of(tokens)
                    for k in lengths:
                        lo = np.array([a for a, b in lines if b - a == k], np.int64) if k < shortest else np.arange(len(tokens) - k + 1)
                        h = rolling(known, k)[lo] if len(lo) else np.empty(0, np.uint64)
                        for p in np.flatnonzero(shared.value.holds(_places(h))) if len(h) else ():
                            a = int(lo[p])
                            row.append(i), at.append(a), size.append(k), hashes.append(int(h[p].view(np.int64))), text.append(" ".join(tokens[a : a + k]))
                own = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("h").take(own), batch.column("g").take(own), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(hashes, pa.int64()), pa.array(text, pa.string())], ["h", "g", "at", "length", "hash", "gram"])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, at, total, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "at", "total", "gone")), strict=True):
                spans = merge([(x["lo"], x["hi"]) for x in at])
                total = len(words(t)) if total < 0 else total
                gone += sum(hi - lo for lo, hi in spans)
                out.append((None if gone >= drop_share * total else cut(t, spans), total, gone))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64())))], ["h", "g", "text", "total", "gone"])

    own = docs.where("text is not null").select(*(c.alias(k) for c, k in zip(row_id(docs, ["text"]), "hg", strict=True)), "text", F.lit(-1).cast("long").alias("total"), F.lit(0).cast("long").alias("gone"))
    done: DataFrame | None = None
    todo, turn = own, 0
    while True:
        windows = todo.select("h", "g", "text").mapInArrow(find, "h long, g long, at int, length int, hash long, gram string")
        hits = windows.join(grams, ["hash", "gram", "length"]).groupBy("h", "g").agg(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("length")).alias("hi"))).alias("at"))
        hits = ws.table(hits, f"hits-{turn}")
        if not (many := hits.count()):
            break
        texts = _held(todo, IdFilter(hits.select("h", "g"), many), "h", "g").where("maybe").drop("maybe").dropDuplicates(["h", "g"])
        now = ws.table(texts.join(hits, ["h", "g"]).mapInArrow(apply, "h long, g long, text string, total long, gone long"), f"cut-{turn}")
        done = now if done is None else done.join(now.select("h", "g"), ["h", "g"], "left_anti").unionByName(now)
        todo, turn = now.where("text is not null"), turn + 1
    if done is None:
        return docs
    done = ws.table(done, "done")
    h, g, maybe, new, hit = free_names(docs, "h", "g", "maybe", "new", "hit")
    asked = docs.select("*", *(c.alias(k) for c, k in zip(row_id(docs, ["text"]), (h, g), strict=True)))
    asked = _held(asked, IdFilter(done.select("h", "g"), done.count()), h, g, maybe)
    rest = asked.where(~F.col(maybe)).select(*docs.columns)
    out = asked.where(maybe).join(done.select(F.col("h").alias(h), F.col("g").alias(g), F.col("text").alias(new), F.lit(True).alias(hit)), [h, g], "left").where(F.col(hit).isNull() | F.col(new).isNotNull())
    out = out.withColumn("text", F.when(F.col(hit), F.col(new)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.unionByName(out.select(*docs.columns))


def _held(table: DataFrame, ids: IdFilter, h: str, g: str, maybe: str = "maybe") -> DataFrame:
    """``table`` with ``maybe``: whether the filter holds the row's id."""
    shared = table.sparkSession.sparkContext.broadcast(ids)
    names, columns = free_names(table, *(f"p{k}" for k in range(IdFilter.HASHES))), table.columns
    asked = table.select("*", *(c.alias(k) for c, k in zip(IdFilter.places(F.col(h), F.col(g)), names, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = shared.value.holds([b.column(p).to_numpy() for p in names])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(hit)], [*columns, maybe])

    return asked.mapInArrow(run, StructType([*table.schema, StructField(maybe, BooleanType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
