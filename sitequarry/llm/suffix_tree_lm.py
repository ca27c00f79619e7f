"""Language-model scoring with a probabilistic suffix tree over words.

The symbols of a text are its words and an end mark. A state is a context: the last two or three words, or nothing. A context is
kept if what follows it diverges from what its shorter suffix says: N * KL >= ``evidence``; one that occurs once says nothing but itself.
Next-word distributions are smoothed towards the suffix's, down to the empty context, which spells words by a suffix tree over
letters (contexts of up to ``DEPTH`` letters). Each word is scored by the longest kept suffix of what precedes it.

The tree grows with the corpus and is never held in one place. All contexts with the same last two words are counted, tested and
scored in one task: words travel once, as 12 bytes each with their hashed contexts, and each text's partial sums travel back. Pairs
too frequent for one task are counted as a table, by aggregations and joins; contexts are known by the same hashes and kept by the same
test, so that scores don't depend on which way a pair goes. Only the tree of letters, bounded by 32^5 counts, goes to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TokenHash, Workspace, broadcast_if_small, free_names, key_runs, mix64, row_id, words

DEPTH, BITS, EVIDENCE, PRIOR = 4, 5, 25.0, 8.0  # of the tree of letters
WORD_EVIDENCE, WORD_PRIOR = 8.0, 1.0
#: Words of a block that a task sends off together, and of a part of the tree.
BLOCK, PART = 1_000_000, 1_500_000
#: What follows a pair of words that occurs more often than this, and makes more than ``SHARE`` of a block somewhere, is counted as a table, with the same scores.
FREQUENT, SHARE = 4_000_000, 1e-4
_SYMBOLS = 1 << BITS
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = 4  # parts of a bit in which the probability of a spelling is sent


# == words by letters


def spell(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of DEPTH + 1 symbols ending at each symbol of each word and at its end, start of each word).

    A letter a-z is one symbol; any other character is a mark and its code point in digits of 5 bits, so that every script is kept apart.
    """
    points = np.frombuffer("".join(tokens).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    plain, wide = (points >= 97) & (points <= 122), points >= 1 << 15
    size = np.where(plain, 1, np.where(wide, 6, 4))
    ends = np.cumsum(size)
    letters = np.cumsum([len(t) for t in tokens])
    last = np.concatenate([[0], ends])[letters]  # of each word, in symbols
    at = ends - size + DEPTH + (DEPTH + 1) * np.repeat(np.arange(len(tokens)), np.diff(letters, prepend=0))
    s = np.zeros(int(last[-1] if len(last) else 0) + (DEPTH + 1) * len(tokens), np.int64)
    s[at[plain]] = points[plain] - 97 + 4
    for own, mark, digits in ((~plain & ~wide, 31, 3), (wide, 30, 5)):
        s[at[own]] = mark
        for d in range(digits):
            s[at[own] + d + 1] = points[own] >> BITS * (digits - 1 - d) & (_SYMBOLS - 1)
    code = s.copy()
    for i in range(1, DEPTH + 1):
        code[i:] |= s[:-i] << BITS * i
    begin = np.concatenate([[0], last[:-1]]) + (DEPTH + 1) * np.arange(len(tokens))
    keep = np.ones(len(s), bool)
    for i in range(DEPTH):
        keep[begin + i] = False
    return (code & ((1 << BITS * (DEPTH + 1)) - 1))[keep], begin - DEPTH * np.arange(len(tokens))


def _reduce(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class LetterTree:
    """``state[context of DEPTH symbols]`` is the longest kept suffix, ``logp[state]`` its next-symbol distribution (base 2)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, evidence: float = EVIDENCE, prior: float = PRIOR):
        self.state = np.zeros(1 << BITS * DEPTH, np.int32)
        root = np.bincount(codes & (_SYMBOLS - 1), counts, _SYMBOLS) + 1.0
        smoothed = {0: (np.zeros(1, np.int64), (root / root.sum())[None])}
        kept: dict[int, set[int]] = {}
        levels = {}
        for d in range(1, DEPTH + 1):
            c, n = _reduce(codes & ((1 << BITS * (d + 1)) - 1), counts)
            ctx, row = np.unique(c >> BITS, return_inverse=True)
            table = np.zeros((len(ctx), _SYMBOLS))
            table[row, c & (_SYMBOLS - 1)] = n
            above, p = smoothed[d - 1]
            parent = p[np.searchsorted(above, ctx & ((1 << BITS * (d - 1)) - 1))]
            total = table.sum(axis=1, keepdims=True)
            q = table / total
            gain = (total * q * np.log(np.where(q > 0, q / parent, 1.0))).sum(axis=1)
            smoothed[d] = (ctx, (table + prior * parent) / (total + prior))
            kept[d] = set(ctx[gain >= evidence].tolist())
            levels[d] = ctx
        for d in range(DEPTH, 1, -1):  # with a context all its suffixes are in the tree
            kept[d - 1] |= {x & ((1 << BITS * (d - 1)) - 1) for x in kept[d]}
        logs, self.contexts = [np.log2(smoothed[0][1])], [(0, 0)]
        for d in range(1, DEPTH + 1):
            own = np.array(sorted(kept[d]), np.int64)
            ids = len(self.contexts) + np.arange(len(own))
            self.state.reshape(-1, 1 << BITS * d)[:, own] = ids
            logs.append(np.log2(smoothed[d][1][np.searchsorted(levels[d], own)]))
            self.contexts += [(d, int(x)) for x in own]
        self.logp = np.concatenate(logs).astype(np.float32)

    def steps(self, tokens: list[str]) -> np.ndarray:
        """-log2 of each word's probability, in quarters of a bit, rounded up (255 at most)."""
        if not tokens:
            return np.empty(0, np.uint8)
        codes, starts = spell(tokens)
        v = self.logp.reshape(-1)[self.state[codes >> BITS].astype(np.int64) << BITS | (codes & (_SYMBOLS - 1))]
        return np.minimum(255, np.ceil(-_STEP * np.add.reduceat(v, starts, dtype=np.float64) - 1e-3)).astype(np.uint8)


# == the corpus


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[list[str]]]]:
    """Texts (not null) of about ``BLOCK`` words together: (batches of their other columns, words)."""
    held, tokens, size = [], [], 0
    for whole in batches:
        whole = whole.filter(whole.column("text").is_valid())
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            new = [words(t.as_py()) for t in b.column("text")]
            held.append(b.drop_columns(["text"]))
            tokens += new
            size += sum(map(len, new))
            if size >= BLOCK:
                yield held, tokens
                held, tokens, size = [], [], 0
    if tokens:
        yield held, tokens


def _contexts(tokens: list[list[str]], hasher: TokenHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word and end mark: hash of the two words before, of the word before those, of itself; and the text it is in."""
    sizes = np.array([len(t) for t in tokens])
    s = np.full(int(sizes.sum()) + 4 * len(tokens), _BEGIN, np.uint64)
    own = np.repeat(np.arange(len(tokens)), sizes + 1)
    first = np.cumsum(sizes + 4) - sizes - 1  # of each text, after three begin marks
    for t, at in zip(tokens, first, strict=True):
        s[at : at + len(t)] = hasher.of(t)
    s[first + sizes] = _END
    at = np.arange(len(own)) + 3 * (own + 1)
    return mix64(s[at - 2] * _MUL + s[at - 1]), s[at - 3], s[at], own


def gathered(docs: DataFrame) -> tuple[LetterTree, int, np.ndarray]:
    """(the tree of letters, number of symbols, hashes of the frequent pairs), counted over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHash()
        for _, tokens in _blocks(batches):
            hasher.trim()
            count = Counter({"": len(tokens)})
            for t in tokens:
                count.update(t)
            codes, starts = spell(list(count))
            n = np.repeat(np.fromiter(count.values(), np.int64, len(count)), np.diff(np.append(starts, len(codes))))
            codes, n = _reduce(codes, n)
            pair, times = np.unique(_contexts(tokens, hasher)[0], return_counts=True)
            often = times > max(1, SHARE * times.sum())
            kind = np.repeat([0, 1, 2], [len(codes), often.sum(), 1])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.concatenate([codes, pair[often].view(np.int64), [0]])), pa.array(np.concatenate([n, times[often], [times.sum()]]))], ["kind", "code", "n"])

    t = docs.select("text").mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).where(F.expr(f"kind <> 1 or n > {FREQUENT}")).toArrow()
    kind, code, n = (t.column(c).to_numpy() for c in ("kind", "code", "n"))
    return LetterTree(code[kind == 0], n[kind == 0]), int(n[kind == 2].sum()), np.sort(code[kind == 1].view(np.uint64))


def part_scores(pair: np.ndarray, third: np.ndarray, word: np.ndarray, base: np.ndarray, whole: bool, evidence: float, prior: float) -> np.ndarray:
    """log2 probability of each occurrence, of all that follow the same pairs. ``base``: log2 of the word's spelling. If not ``whole``, the contexts of three words only."""
    order = np.lexsort((word, third, pair))
    pair, third, word, base = pair[order], third[order], word[order], base[order]

    def first(*columns: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(pair), bool)
        cut[:1] = True
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        return cut

    def total(group: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(group, x)[group]

    def level(group: np.ndarray, times: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = total(group)
        gain = total(group, np.log(times / n / parent))
        return (times + prior * parent) / (n + prior), (n > 1) & (gain >= evidence)

    root = 2.0**base
    p, kept = root, np.zeros(len(pair), bool)
    two = np.cumsum(first(pair)) - 1
    three = np.cumsum(first(pair, third)) - 1
    if whole:
        by_word = np.lexsort((word, pair))
        cut = np.concatenate([[True], (pair[by_word][1:] != pair[by_word][:-1]) | (word[by_word][1:] != word[by_word][:-1])]) if len(pair) else np.empty(0, bool)
        times = np.empty(len(pair))
        times[by_word] = total(np.cumsum(cut) - 1)
        p, kept = level(two, times, root)
    deep, held = level(three, total(np.cumsum(first(pair, third, word)) - 1), p)
    if whole:
        kept = total(two, (kept | held).astype(float)) > 0  # with a context its suffix is in the tree
    out = np.empty(len(pair))
    out[order] = np.log2(np.where(held, deep, np.where(kept, p, root)))
    return out


def pair_scores(found: DataFrame, pairs: int, ws: Workspace, evidence: float, prior: float) -> DataFrame:
    """(block, text, log2) of ``found``'s rows: what ``part_scores`` says, by aggregations and joins. ``found``: block, pair, third, word
    (its spelling in the bits from the 24th), n and text, of ``pairs`` different pairs."""
    n, m, p, every = (F.col(c) for c in ("n", "m", "p", "every"))
    root = F.pow(F.lit(2.0), -F.shiftright("word", 24) / _STEP)
    deep = ws.table(found.groupBy("pair", "third", "word").agg(F.sum("n").alias("n")), "contexts")
    two = deep.groupBy("pair", "word").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("every"), F.sum(n * F.log(n / root)).alias("gain"))
    two = two.select("pair", "every", ((every > 1) & (F.col("gain") - every * F.log(every) >= evidence)).alias("kept"))
    deep = deep.join(broadcast_if_small(two, pairs, 64), "pair")
    deep = deep.withColumn("p", (F.sum("n").over(Window.partitionBy("pair", "word")) + prior * root) / (every + prior))
    three = Window.partitionBy("pair", "third")
    deep = deep.withColumns({"m": F.sum("n").over(three), "gain": F.sum(n * F.log(n / p)).over(three)})
    deep = ws.table(deep.withColumn("held", (m > 1) & (F.col("gain") - m * F.log(m) >= evidence)), "tested")
    two = deep.groupBy("pair").agg(F.max(F.col("kept") | F.col("held")).alias("state"))  # with a context its suffix is in the tree
    log = F.log2(F.when(F.col("held"), (n + prior * p) / (m + prior)).when(F.col("state"), p).otherwise(root))
    logs = deep.join(broadcast_if_small(two, pairs, 64), "pair").select("pair", "third", "word", log.alias("log2"))
    return found.drop("n").join(logs, ["pair", "third", "word"]).select("block", "text", "log2")


def scores(docs: DataFrame, ws: Workspace, *, evidence: float = WORD_EVIDENCE, prior: float = WORD_PRIOR) -> DataFrame:
    """(h, g, symbols, log2, apart) of every text that isn't null, by the identity of its row over doc_id and text; of repeated rows as many.
    Where there are frequent pairs, a text has two such rows to be added up: ``apart`` is what follows frequent pairs."""
    tree, size, frequent = gathered(docs)
    parts = max(1, -(-size // PART))
    shared = docs.sparkSession.sparkContext.broadcast((tree, frequent))
    rows = docs.select(*(c.alias(k) for c, k in zip(row_id(docs, ["doc_id", "text"]), "hg", strict=True)), "text")
    fields = ["part", "block", "pair", "third", "word", "base", "text", "h", "g"]
    schema = "part long, block long, pair binary, third binary, word binary, base binary, text binary, h binary, g binary"

    def coded(batches: Iterable[pa.RecordBatch], apart: bool) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of every block its number, its texts' sizes and identities; and the words that follow frequent pairs, or those that don't: hashes of
        the pair, of the word before and of itself, its spelling and its text."""
        tree, often = shared.value
        hasher, spelt = TokenHash(), {}
        for held, tokens in _blocks(batches):
            hasher.trim()
            if len(spelt) > 500_000:
                spelt.clear()
            fresh = list({"", *(w for t in tokens for w in t)} - spelt.keys())
            spelt |= dict(zip(fresh, tree.steps(fresh).tolist(), strict=True))
            base = np.concatenate([np.fromiter((spelt[w] for w in [*t, ""]), np.uint8, len(t) + 1) for t in tokens])
            pair, third, word, own = _contexts(tokens, hasher)
            if len(often):
                mine = np.isin(pair, often) == apart
                pair, third, word, base, own = (x[mine] for x in (pair, third, word, base, own))
            third, word = (mix64(third) >> np.uint64(48)).astype(np.uint16), (mix64(word) >> np.uint64(40)).astype(np.uint32)
            ids = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in "hg"]
            block = xxhash.xxh3_64_intdigest(ids[0].tobytes() + ids[1].tobytes()) >> 1
            yield block, [np.array([len(t) + 1 for t in tokens], np.uint32), *ids], pair, third, word, base, own.astype(np.uint32)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, head, pair, third, word, base, own in coded(batches, False):
            part = pair % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            word = word.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            low = (mix64(pair ^ _MUL) >> np.uint64(32)).astype(np.uint32)
            for own_part in np.split(order, cut) if len(order) else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[own_part[0]])]), pa.array([block]), *(pa.array([np.ascontiguousarray(x[own_part]).tobytes()], pa.binary()) for x in (low, third, word, base, own)), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())],
                    fields,
                )
            yield pa.RecordBatch.from_arrays([pa.array([parts + block % parts]), pa.array([block]), *[pa.nulls(1, pa.binary())] * 4, *(pa.array([x.tobytes()], pa.binary()) for x in head)], fields)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["block", "text", "log2", "h", "g"]
        for t, runs in key_runs(batches, "part"):
            for lo, hi in zip(runs[:-1], runs[1:], strict=True):
                own = t.slice(lo, hi - lo)
                blocks = own.column("block")
                if own.column("part")[0].as_py() >= parts:
                    for b in own.select(["block", "text", "h", "g"]).to_batches():
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows, pa.binary()), b.column(2), b.column(3)], out)
                    continue
                pair, third, word, base, text = (np.frombuffer(b"".join(own.column(c).to_pylist()), k) for c, k in (("pair", np.uint32), ("third", np.uint16), ("word", np.uint8), ("base", np.uint8), ("text", np.uint32)))
                word = word.reshape(-1, 3).astype(np.uint32)
                log = part_scores(pair, third, word[:, 0] | word[:, 1] << 8 | word[:, 2] << 16 | base.astype(np.uint32) << 24, -base.astype(float) / _STEP, True, evidence, prior)
                at = 0
                for i in range(len(blocks)):
                    n = len(own.column("base")[i].as_py())
                    where, back = np.unique(text[at : at + n], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([blocks.slice(i, 1).combine_chunks(), pa.array([where.tobytes()], pa.binary()), pa.array([np.bincount(back, log[at : at + n]).tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], out)
                    at += n

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different context and word of a block that follow frequent pairs, with its occurrences' texts; and the block's head."""
        names = ["block", "pair", "third", "word", "n", "text", "h", "g"]
        for block, head, pair, third, word, base, own in coded(batches, True):
            word = word.astype(np.int64) | base.astype(np.int64) << 24
            order = np.lexsort((word, third, pair))
            pair, third, word, own = pair[order], third[order], word[order], own[order]
            cut = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1]) | (word[1:] != word[:-1])])) if len(pair) else np.empty(0, np.int64)
            ends = np.append(cut, len(pair))
            texts = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block, np.int64)), pa.array(pair[cut].view(np.int64)), pa.array(third[cut].astype(np.int32)), pa.array(word[cut]), pa.array(np.diff(ends)), texts, *[pa.nulls(len(cut), pa.binary())] * 2], names)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * 2, *(pa.array([x.tobytes()], pa.binary()) for x in head)], names)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log2 of a row as often as it has texts."""
        for b in batches:
            texts = b.column("text").to_pylist()
            times = np.array([len(t) // 4 for t in texts], np.int64)
            ends = np.append(0, 8 * np.cumsum(times)).astype(np.int32)
            log = pa.Array.from_buffers(pa.binary(), len(times), [None, pa.py_buffer(ends), pa.py_buffer(np.repeat(b.column("log2").to_numpy(), times))])
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(texts, pa.binary()), log, *[pa.nulls(len(times), pa.binary())] * 2], ["block", "text", "log2", "h", "g"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in key_runs(batches, "block"):
            for lo, hi in zip(runs[:-1], runs[1:], strict=True):
                own = t.slice(lo, hi - lo)
                heads, rest = own.filter(own.column("h").is_valid()).to_pylist(), own.filter(own.column("h").is_null())
                sizes = np.frombuffer(heads[0]["text"], np.uint32)
                text, each = (np.frombuffer(b"".join(rest.column(c).to_pylist()), k) for c, k in (("text", np.uint32), ("log2", np.float64)))
                log = np.bincount(text, each, len(sizes))
                ids = [pa.array(np.frombuffer(heads[0][c], np.int64)) for c in "hg"]
                for _ in heads:  # equal blocks have equal sums, each counted len(heads) times
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes.astype(np.int64)), pa.array(log / len(heads))], ["h", "g", "symbols", "log2"])

    def added(back: DataFrame) -> DataFrame:
        return back.repartition("block").sortWithinPartitions("block").mapInArrow(add, "h long, g long, symbols long, log2 double")

    sums = "block long, text binary, log2 binary, h binary, g binary"
    sent = rows.mapInArrow(send, schema).repartition("part").sortWithinPartitions("part")
    out = added(sent.mapInArrow(judge, sums)).withColumn("apart", F.lit(False))
    if not len(frequent):
        return out
    found = ws.table(rows.mapInArrow(contexts, "block long, pair long, third int, word long, n long, text binary, h binary, g binary"), "found")
    heads = found.where("h is not null").select("block", "text", F.lit(None).cast("binary").alias("log2"), "h", "g")
    apart = pair_scores(found.where("h is null").drop("h", "g"), len(frequent), ws, evidence, prior).mapInArrow(spread, sums)
    return out.unionByName(added(apart.unionByName(heads)).withColumn("apart", F.lit(True)))


def score(docs: DataFrame, *, evidence: float = WORD_EVIDENCE, prior: float = WORD_PRIOR, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or these columns of it) with lm_symbols (long), lm_log2 and lm_bits (doubles: log2 probability, bits a symbol) by a
    tree of all its texts, replacing columns of these names.

    Symbols are lower-case ``\\w+`` runs of the whole text, however long, and the end mark, so that an empty text has a score. A null text
    has nulls. Rows of the same doc_id and text have the same score and all stay; equal texts have equal scores up to rounding. An
    empty table gives no rows. The order of a partition's rows must not change when it is computed again, as in a scan of files.
    """
    names = ["lm_symbols", "lm_log2", "lm_bits"]
    h, g = free_names(docs, "h", "g")
    own = docs.select(*[c for c in columns or docs.columns if c not in names], *(c.alias(k) for c, k in zip(row_id(docs, ["doc_id", "text"]), (h, g), strict=True)))
    ws = Workspace(docs.sparkSession, "suffix-tree")
    found = ws.table(scores(docs, ws, evidence=evidence, prior=prior), "scores")
    ws.drop("found", "contexts", "tested")
    apart = F.coalesce(F.max(F.when(F.col("apart"), F.col("log2"))), F.lit(0.0))
    found = found.groupBy("h", "g").agg(F.max("symbols").alias(names[0]), (F.max(F.when(~F.col("apart"), F.col("log2"))) + apart).alias(names[1]))
    found = found.withColumnsRenamed({"h": h, "g": g})
    return own.join(found, [h, g], "left").drop(h, g).withColumn(names[2], -F.col(names[1]) / F.col(names[0]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])
