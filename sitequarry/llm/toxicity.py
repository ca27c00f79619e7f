"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy.

A word's input joins the vector of the word and the mean vector of its character n-grams (both hashed), so that unseen words have
one too. Windows of words overlap by half and cover every text; each is read in both directions, pooled by attention and given a
probability; a document has that of its worst window. Training knows labels of documents only: it fits on the window of each
labelled document that is worst so far, in several rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import TokenHash, labelled_sample, mix64, words

TRAIN, WIDTH, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 3000, 32, 16, 8, 8, 16, 8
WORD_BITS, CHAR_BITS, ORDERS, ROUNDS, STEPS, RATE, THRESHOLD = 12, 13, (3, 4), 4, 300, 0.01, 0.9
_BATCH = 2048


def char_grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all tokens, end of each token's): each token with a mark at both ends."""
    flat = np.frombuffer("".join(f"^{t}$" for t in tokens).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + 2 for t in tokens])
    own = np.repeat(np.arange(len(tokens)), size)
    grams, owner = [], []
    for n in ORDERS:
        if len(flat) >= n:
            h = flat[: len(flat) - n + 1].copy()
            for i in range(1, n):
                h = h * np.uint64(0x100000001B3) + flat[i : len(flat) - n + 1 + i]
            inside = own[: len(h)] == own[n - 1 :]
            grams.append((mix64(h[inside] + np.uint64(n)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
            owner.append(own[: len(h)][inside])
    g, o = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return g[order], np.cumsum(np.bincount(o, minlength=len(tokens)))


def windows(count: int, width: int = WIDTH, stride: int = STRIDE) -> np.ndarray:
    """First words of the windows over a text of so many words: one every ``stride`` words, the last one ending with the text."""
    if count <= width:
        return np.zeros(min(count, 1), np.int64)
    starts = np.arange(0, count - width, stride)
    return np.append(starts, count - width)


def _scatter(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row at its place."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    into[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, forward and backward passes. Arrays run over (step, window, unit)."""

    def __init__(self, seed: int = 5, width: int = WIDTH, stride: int = STRIDE):
        if not 0 < stride <= width:
            raise ValueError("windows must cover the text: stride must be between 1 and width")
        self.width, self.stride = width, stride
        r = np.random.default_rng(seed)
        d, h, g = WORD_DIM + CHAR_DIM, HIDDEN, 3 * HIDDEN

        def init(*shape: int, scale: float | None = None) -> np.ndarray:
            return (r.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        self.p = {"word": init(1 << WORD_BITS, WORD_DIM, scale=0.02), "char": init(1 << CHAR_BITS, CHAR_DIM, scale=0.1)}
        for side in "fb":
            self.p |= {f"W{side}": init(d, g), f"b{side}": np.zeros(g, np.float32), f"U{side}": init(h, g), f"q{side}": np.zeros(h, np.float32)}
        self.p |= {"A": init(2 * h, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION), "w": init(2 * h), "c": np.zeros(1, np.float32)}

    def inputs(self, tokens: list[str], hasher: TokenHash) -> tuple[np.ndarray, tuple]:
        grams, ends = char_grams(tokens)
        slot = (hasher.of(tokens) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        mean = np.add.reduceat(self.p["char"][grams], starts, axis=0) / np.maximum(1, ends - starts)[:, None].astype(np.float32)
        return np.hstack([self.p["word"][slot], mean]), (slot, grams, ends - starts)

    def _read(self, gates: np.ndarray, side: str, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
        h, u, q0 = HIDDEN, self.p[f"U{side}"], self.p[f"q{side}"]
        state, out, kept = np.zeros((gates.shape[1], h), np.float32), np.empty((*gates.shape[:2], h), np.float32), []
        for t in range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1):
            y = state @ u
            rz = _sigmoid(gates[t, :, : 2 * h] + y[:, : 2 * h])
            q = y[:, 2 * h :] + q0
            n = np.tanh(gates[t, :, 2 * h :] + rz[:, :h] * q)
            new = n + rz[:, h:] * (state - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, state)
            if keep:
                kept.append((t, state, rz, q, n))
            state = out[t] = new
        return out, kept

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray | None, keep: bool = False):
        """Logit of each window; ``gates``: what the inputs add to each gate."""
        f, kf = self._read(gates["f"], "f", mask, keep)
        b, kb = self._read(gates["b"], "b", mask, keep)
        both = np.concatenate([f, b], axis=2)
        e = np.tanh(both @ self.p["A"] + self.p["a"])
        s = e @ self.p["v"]
        if mask is not None:
            s = np.where(mask, s, -1e9)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, both)
        logit = pooled @ self.p["w"] + self.p["c"]
        return (logit, (kf, kb, both, e, a, pooled)) if keep else logit

    def gradients(self, tokens: np.ndarray, x: np.ndarray, parts: tuple, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss. ``tokens``: (step, window) rows of x."""
        p, h, xs = self.p, HIDDEN, x[tokens]
        logit, (kf, kb, both, e, a, pooled) = self.forward({s: xs @ p[f"W{s}"] + p[f"b{s}"] for s in "fb"}, mask, True)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        da = np.einsum("bh,tbh->tb", dp, both)
        ds = a * (da - (a * da).sum(axis=0))
        de = ds[..., None] * p["v"] * (1 - e * e)
        g["v"], g["a"] = np.einsum("tb,tba->a", ds, e), de.sum(axis=(0, 1))
        g["A"] = both.reshape(-1, 2 * h).T @ de.reshape(-1, ATTENTION)
        dboth = a[..., None] * dp + de @ p["A"].T
        dx = np.zeros_like(xs)
        for side, kept, dh_all in (("f", kf, dboth[..., :h]), ("b", kb, dboth[..., h:])):
            u, dgates, carry = p[f"U{side}"], np.zeros((*xs.shape[:2], 3 * h), np.float32), np.zeros((xs.shape[1], h), np.float32)
            for t, state, rz, q, n in reversed(kept):
                dh = dh_all[t] + carry
                m = mask[t][:, None]
                live, r, z = dh * m, rz[:, :h], rz[:, h:]
                dn = live * (1 - z) * (1 - n * n)
                dq = dn * r
                dr, dz = dn * q * r * (1 - r), live * (state - n) * z * (1 - z)
                dy = np.concatenate([dr, dz, dq], axis=1)
                dgates[t] = np.concatenate([dr, dz, dn], axis=1)
                g[f"U{side}"] += state.T @ dy
                g[f"q{side}"] += dq.sum(axis=0)
                carry = dh * ~m + live * z + dy @ u.T
            flat = dgates.reshape(-1, 3 * h)
            g[f"W{side}"], g[f"b{side}"] = xs.reshape(-1, xs.shape[2]).T @ flat, flat.sum(axis=0)
            dx += dgates @ p[f"W{side}"].T
        dt = np.zeros_like(x)
        _scatter(dt, tokens.reshape(-1), dx.reshape(-1, x.shape[1]))
        slot, grams, size = parts
        _scatter(g["word"], slot, dt[:, :WORD_DIM])
        _scatter(g["char"], grams, np.repeat(dt[:, WORD_DIM:] / np.maximum(1, size)[:, None], size, axis=0))
        return g


class Reader:
    """Scores texts with a network; remembers what each word adds to the gates."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.hasher, self.most = net, TokenHash(), most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = {s: np.zeros((1024, 3 * HIDDEN), np.float32) for s in "fb"}

    def index(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > self.most:
            self.clear()
            self.hasher.clear()
        fresh = list({w for t in texts for w in t} - self.rows.keys())
        if fresh:
            have = len(self.rows)
            x, _ = self.net.inputs(fresh, self.hasher)
            self.rows |= {w: have + i for i, w in enumerate(fresh)}
            for s, g in self.gates.items():
                if len(g) < len(self.rows):
                    g = self.gates[s] = np.concatenate([g, np.zeros((max(len(g), len(self.rows)), g.shape[1]), np.float32)])
                g[have : len(self.rows)] = x @ self.net.p[f"W{s}"] + self.net.p[f"b{s}"]
        return [np.fromiter(map(self.rows.__getitem__, t), np.int64, len(t)) for t in texts]

    def score(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probability of each window of each text."""
        ids = self.index(texts)
        width = self.net.width
        starts = [windows(len(t), width, self.net.stride) for t in ids]
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(texts)
        flat = np.concatenate([*ids, np.zeros(width, np.int64)])
        offset = np.cumsum([0, *(len(i) for i in ids[:-1])])
        counts = np.array([len(s) for s in starts])
        at = np.concatenate([s + o for s, o in zip(starts, offset, strict=True)]) if len(starts) else np.empty(0, np.int64)
        sizes = np.repeat(np.minimum([len(i) for i in ids], width), counts)
        prob = np.empty(len(at), np.float32)
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), _BATCH):
            rows = order[lo : lo + _BATCH]
            most = int(sizes[rows[0]])
            token = flat[at[rows][None] + np.arange(most)[:, None]]
            mask = None if sizes[rows[-1]] == most else np.arange(most)[:, None] < sizes[rows][None]
            prob[rows] = _sigmoid(self.net.forward({s: g[token] for s, g in self.gates.items()}, mask))
        for i, part in enumerate(np.split(prob, np.cumsum(counts)[:-1])):
            out[i] = part
        return out


def _suspects(texts: list[list[str]], y: np.ndarray, width: int, stride: int) -> list[np.ndarray]:
    """A first guess at each window's toxicity: the strongest character n-gram, by log-odds of the labelled documents."""
    vocabulary = sorted({w for t in texts for w in t})
    grams, ends = char_grams(vocabulary)
    starts, where = np.concatenate([[0], ends[:-1]]), {w: i for i, w in enumerate(vocabulary)}
    df = np.ones((2, 1 << CHAR_BITS))
    ids = [np.fromiter(map(where.__getitem__, t), np.int64, len(t)) for t in texts]
    for own, label in zip(ids, y, strict=True):
        if len(own):
            u = np.unique(own)
            df[int(label), np.unique(np.concatenate([grams[starts[i] : ends[i]] for i in u]))] += 1
    odds = np.log(df[1] / (y.sum() + 2)) - np.log(df[0] / ((1 - y).sum() + 2))
    strength = np.maximum.reduceat(odds[grams] * np.sqrt(np.minimum(df[1][grams], 50)), starts)
    return [np.array([strength[own[s : s + width]].max() for s in windows(len(own), width, stride)]) for own in ids]


def fit(texts: list[str], labels: list[int], *, rounds: int = ROUNDS, steps: int = STEPS, rate: float = RATE, seed: int = 5, width: int = WIDTH, stride: int = STRIDE) -> Network:
    """``rounds`` times, picks each document's worst window and takes ``steps`` gradient steps of 64 windows, however many there are."""
    net, rng, y = Network(seed, width, stride), np.random.default_rng(seed), (np.array(labels) > 0).astype(np.float32)
    tokens = [words(t) for t in texts]
    full = [i for i, t in enumerate(tokens) if t]
    tokens, y = [tokens[i] for i in full], y[full]
    worst = _suspects(tokens, y, width, stride)
    (m, v), step = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2)), 0
    for turn in range(rounds):
        if turn:
            worst = Reader(net).score(tokens)
        picked, goal = [], []
        for t, s, label in zip(tokens, worst, y, strict=True):
            starts = windows(len(t), width, stride)
            own = {int(starts[int(np.argmax(s))])}
            if not label:
                own.add(int(rng.choice(starts)))
            for a in own:
                picked.append(t[a : a + width])
                goal.append(label)
        goal = np.array(goal, np.float32)
        share = np.clip(goal.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(goal > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        hasher = TokenHash()
        order = np.concatenate([rng.permutation(len(picked)) for _ in range(-(-steps * 64 // len(picked)))])
        for lo in range(0, steps * 64, 64):
            rows = order[lo : lo + 64]
            chosen = [picked[i] for i in rows]
            local = {w: i for i, w in enumerate(dict.fromkeys(w for t in chosen for w in t))}
            x, parts = net.inputs(list(local), hasher)
            size = np.array([len(t) for t in chosen])
            token, mask = np.zeros((size.max(), len(rows)), np.int64), np.arange(size.max())[:, None] < size[None]
            for j, t in enumerate(chosen):
                token[: len(t), j] = [local[w] for w in t]
            g = net.gradients(token, x, parts, mask, goal[rows], weight[rows])
            step += 1
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                net.p[k] = net.p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", rows: int = TRAIN, width: int = WIDTH, stride: int = STRIDE) -> Network | None:
    """Fits on at most ``rows`` labelled texts, half of each class at most, drawn by hash; None unless there are both classes.

    Of a doc_id with several labels the largest counts; null ids, labels and texts don't.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("y"))
    data = labelled_sample(docs, own, rows // 2)
    return fit([t for t, _ in data], [y for _, y in data], width=width, stride=stride) if len({y for _, y in data}) == 2 else None


def score(docs: DataFrame, net: Network | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with toxic_windows (long), toxic_score (double) and toxic (score >= threshold), replacing columns of these names.

    The score is that of the worst of all overlapping windows (the network's ``width`` words, one every ``stride``) of the whole text,
    however long; a score of exactly the threshold is toxic. A text without words (null and empty included),
    or a missing model, has 0 windows, a null score and is not toxic. Equal texts have equal scores up to rounding. Other columns,
    whatever their names, and the rows' multiplicity stay; an empty table gives no rows.
    """
    names = ["toxic_windows", "toxic_score", "toxic"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(shared.value) if shared.value is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [words(t.as_py()) if own else [] for t in batch.column("text")]
                p = own.score(texts) if own else [np.empty(0)] * len(texts)
                n = np.array([len(x) for x in p])
                s = np.array([float(x.max()) if len(x) else 0.0 for x in p])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(n, pa.int64()), pa.array(s, mask=n == 0), pa.array((n > 0) & (s >= threshold))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(names[0], LongType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
