"""Language identification with a string kernel.

Blended-spectrum presence kernel: k(x, y) = distinct n-grams of 1..3 letters that x and y share, divided by the geometric mean
of their numbers. Landmarks (labelled texts) give the Nyström features, one-versus-rest kernel ridge regression the weights. As
k(x, landmarks) is the product of x's presence vector and the landmarks' presence matrix, a batch of whole texts is scored by two
matrix products. A text is identified only if the landmarks of its language also know enough of its n-grams: the scores of a
language of the model always add up to the same, so that a text in none of them has a best one too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import broadcast_if_small, free_names, row_id

ORDER, LANDMARKS, TRAIN, RIDGE, MARGIN, KNOWN = 3, 96, 250, 1e-2, 0.02, 0.63
#: Languages at most; with more labels, those of the least hashes are learned.
LANGUAGES = 500
_POINTS = 0x40000  # planes with letters
_TABLE_BITS = 6  # up to so many bits a letter, presence is a table of all n-grams


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for whatever is no letter. Vowel signs and other marks count as letters."""
    table = np.zeros(_POINTS, np.uint32)
    for c in range(_POINTS):
        if (s := chr(c)).isalpha() or unicodedata.category(s)[0] == "M":
            table[c] = ord(s.lower()[0])
    return table


def points(text: str) -> np.ndarray:
    """Lower-case letters of a text, 0 for the rest."""
    p = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(p) and p.max() >= _POINTS:
        p = np.where(p < _POINTS, p, 0)
    return letters()[p]


class Presence:
    """Presence of letter n-grams in whole texts, over an alphabet of letters of any script; every other letter counts as one more."""

    def __init__(self, alphabet: np.ndarray):
        self.bits = int(len(alphabet) + 1).bit_length()
        self.number = np.zeros(_POINTS, np.int64)
        self.number[letters()[letters() > 0]] = len(alphabet) + 1
        self.number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.number[0] = 0
        self.seen = np.zeros(sum(1 << self.bits * n for n in range(1, ORDER + 1)), np.uint8) if self.bits <= _TABLE_BITS else None

    def codes(self, text: str) -> np.ndarray:
        """Codes of all n-grams of 1..3, gaps at both ends; those of gaps alone are left out."""
        s = self.number[points(text)]
        s = s[(s > 0) | np.concatenate([[False], s[:-1] > 0])] if len(s) else s  # a gap of any length is one
        s = np.concatenate([[0], s, [0] if len(s) and s[-1] else []]).astype(np.int64)
        out, code, base = [], s, 0
        for n in range(1, ORDER + 1):
            if n > 1:
                code = code[:-1] << self.bits | s[n - 1 :]
            out.append(code[code > 0] + base)
            base += 1 << self.bits * n
        return np.concatenate(out)

    def of(self, text: str | None, columns: np.ndarray) -> tuple[np.ndarray, int]:
        """(presence of the n-grams in ``columns``, number of distinct n-grams)."""
        codes = self.codes(text or "")
        if self.seen is None:
            own = np.unique(codes)
            row = np.zeros(len(columns), np.uint8)
            at = np.searchsorted(columns, own)
            at = at[(at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == own)] if len(columns) else at[:0]
            row[at] = 1
            return row, len(own)
        self.seen[codes] = 1
        row, count = self.seen[columns], int(np.count_nonzero(self.seen))
        self.seen[codes] = 0
        return row, count


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(langs))
        self.alphabet = np.array(sorted(set().union(*(np.unique(points(t)).tolist() for t in texts)) - {0}), np.int64)
        p = Presence(self.alphabet)
        sets = [np.unique(p.codes(t)) for t in texts]
        marks = []
        for lang in self.langs:  # the same number for each language, the texts with most n-grams first
            own = [i for i, x in enumerate(langs) if x == lang and len(sets[i])]
            marks += sorted(own, key=lambda i: (-len(sets[i]), texts[i]))[: max(1, landmarks // len(self.langs))]
        self.columns = np.unique(np.concatenate([sets[i] for i in marks])) if marks else np.empty(0, np.int64)
        x = np.stack([np.isin(self.columns, s, assume_unique=True) for s in sets]).astype(np.float32) if len(self.columns) else np.zeros((len(texts), 0), np.float32)
        self.marks = x[marks].T / np.sqrt([len(sets[i]) for i in marks])  # n-gram by landmark
        k_lm = self.marks.T @ self.marks
        e, v = np.linalg.eigh(k_lm)
        good = e > 1e-6 * e.max() if len(e) else []
        nystrom = v[:, good] / np.sqrt(e[good])
        phi = x @ self.marks / np.sqrt(np.maximum(1, [len(s) for s in sets]))[:, None] @ nystrom
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        balance = 1 / np.array([langs.count(g) for g in langs])[:, None]
        penalty = ridge * np.eye(phi1.shape[1]) * balance.sum()
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve(phi1.T @ (phi1 * balance) + penalty, phi1.T @ (y * balance))
        self.weights, self.bias = (nystrom @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)
        of = np.array([self.langs.index(langs[i]) for i in marks], np.int64)
        self.known = np.stack([(self.marks[:, of == g] > 0).any(axis=1) for g in range(len(self.langs))], axis=1).astype(np.float32)  # n-gram by language
        self.marks = self.marks.astype(np.float32)

    def scores(self, presence: np.ndarray, counts: np.ndarray) -> np.ndarray:
        kernel = presence.astype(np.float32) @ self.marks / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32)
        return kernel @ self.weights + self.bias

    def shares(self, presence: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each text and language: the share of the text's n-grams that the language's landmarks have."""
        return presence.astype(np.float32) @ self.known / np.maximum(counts, 1)[:, None].astype(np.float32)


def training_rows(docs: DataFrame, per_language: int) -> list:
    """(text, lang) of at most ``per_language`` different texts of each label, drawn by hash; null and blank texts and labels don't count.

    Rows are numbered by their 128-bit identities, before any text moves; those drawn are then found by a join with that small table.
    """
    h, g, r = free_names(docs, "h", "g", "r")
    own = docs.where("lang is not null and trim(text) <> ''").select("text", "lang")
    own = own.select("*", *(c.alias(k) for c, k in zip(row_id(own, ["text", "lang"]), (h, g), strict=True)))
    drawn = own.groupBy("lang", h, g).count().withColumn(r, F.row_number().over(Window.partitionBy("lang").orderBy(h, g))).where(F.col(r) <= per_language)
    drawn = drawn.select(h, g).limit(per_language * LANGUAGES)
    got = own.join(broadcast_if_small(drawn, per_language * LANGUAGES, 48), [h, g]).groupBy(h, g).agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
    return sorted((x.text, x.lang) for x in got.collect())


def train(docs: DataFrame, *, per_language: int = TRAIN, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fits on a bounded sample of ``docs`` by its ``lang``; None if there is no labelled text."""
    rows = training_rows(docs, per_language)
    return Model([r[0] for r in rows], [r[1] for r in rows], landmarks, ridge) if rows else None


def _judged(docs: DataFrame, model: Model | None, known: float, margin: float, names: list[str]) -> DataFrame:
    """``docs`` with the columns named, or, without names, the rows that are identified."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        presence = Presence(own.alphabet) if own else None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text")
                n = batch.num_rows
                if own is None:
                    out = [pa.array(["und"] * n), *[pa.nulls(n, pa.float64())] * 3, pa.array([False] * n)]
                else:
                    rows, counts = np.empty((n, len(own.columns)), np.uint8), np.empty(n, np.int64)
                    for i, t in enumerate(texts):
                        rows[i], counts[i] = presence.of(t.as_py(), own.columns)
                    s = own.scores(rows, counts).astype(float)
                    best, none = s.argmax(axis=1), counts == 0
                    top, share = s[np.arange(n), best], own.shares(rows, counts)[np.arange(n), best].astype(float)
                    s[np.arange(n), best] = -np.inf
                    lead = top - s.max(axis=1)
                    out = [
                        pa.array([None if z else own.langs[b] for b, z in zip(best, none, strict=True)], pa.string()).fill_null("und"),
                        pa.array(top, mask=none),
                        pa.array(lead, mask=none | np.isinf(lead)),
                        pa.array(share, mask=none),
                        pa.array(~none & (share >= known) & (lead >= margin)),
                    ]
                if names:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), *out], [*batch.schema.names, *names])
                else:
                    yield batch.filter(out[-1])

    kinds = [StringType(), DoubleType(), DoubleType(), DoubleType(), BooleanType()]
    return docs.mapInArrow(run, StructType([*docs.schema, *(StructField(n, k) for n, k in zip(names, kinds, strict=False))]))


def identify(docs: DataFrame, model: Model | None, *, known: float = KNOWN, margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_margin, lang_known and lang_ok, replacing columns of these names.

    lang_pred is the language of the highest score, 'und' for a text without a letter (null and empty included) or without a model:
    then the numbers are null and lang_ok false. lang_margin is the lead over the next language (null with one language only);
    lang_known the share of the text's n-grams that occur in landmarks of lang_pred. lang_ok: a letter, a share of at least
    ``known`` and a lead of at least ``margin``: a text in a language that isn't among the labels, or of random letters, isn't ok.
    Whole texts count, however long; ties go to the language first in the alphabet (and have no lead); rows keep their
    multiplicity and other columns, whatever their names. Letters of all scripts count. An empty table gives no rows.
    """
    names = ["lang_pred", "lang_score", "lang_margin", "lang_known", "lang_ok"]
    return _judged(docs.drop(*names), model, known, margin, names)


def keep_identified(docs: DataFrame, *, known: float = KNOWN, margin: float = MARGIN) -> DataFrame:
    """``docs`` whose language is identified (as ``lang_ok`` of ``identify`` says, trained on ``docs``), in the same columns."""
    return _judged(docs, train(docs), known, margin, [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "lang", "text"), train(docs)).drop("text")
