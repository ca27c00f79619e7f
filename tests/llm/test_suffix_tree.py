import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitequarry.llm import suffix_tree_lm as P
from sitequarry.llm.common import words


def letters(word):
    """Symbols of a word, one by one."""
    out = []
    for c in word:
        c = ord(c)
        if 97 <= c <= 122:
            out.append(c - 93)
        elif c < 1 << 15:
            out += [31, c >> 10, c >> 5 & 31, c & 31]
        else:
            out += [30, c >> 20, c >> 15 & 31, c >> 10 & 31, c >> 5 & 31, c & 31]
    return out


def spelling(texts):
    """The tree of letters by dictionaries: log2 probability of a word, in quarters of a bit."""
    counts = defaultdict(Counter)
    for w, n in Counter(w for t in texts for w in [*t, ""]).items():
        s = [0] * P.DEPTH + letters(w) + [0]
        for i in range(P.DEPTH, len(s)):
            for d in range(P.DEPTH + 1):
                counts[tuple(s[i - d : i])][s[i]] += n
    n = sum(counts[()].values())
    dist, kept = {(): [(counts[()][a] + 1) / (n + 32) for a in range(32)]}, {()}
    for d in range(1, P.DEPTH + 1):
        for ctx in [c for c in counts if len(c) == d]:
            parent, c = dist[ctx[1:]], counts[ctx]
            total = sum(c.values())
            dist[ctx] = [(c[a] + P.PRIOR * parent[a]) / (total + P.PRIOR) for a in range(32)]
            if sum(v * math.log(v / total / parent[a]) for a, v in c.items()) >= P.EVIDENCE:
                kept |= {ctx[i:] for i in range(len(ctx))}

    def log(w):
        s, out = [0] * P.DEPTH + letters(w) + [0], 0.0
        for i in range(P.DEPTH, len(s)):
            ctx = next(c for d in range(P.DEPTH, -1, -1) if (c := tuple(s[i - d : i])) in kept)
            out += math.log2(dist[ctx][s[i]])
        return -min(255, math.ceil(-4 * out - 1e-3)) / 4

    return log, kept


def brute(texts, evidence=P.WORD_EVIDENCE, prior=P.WORD_PRIOR):
    """(symbols, log2) of each text, by dictionaries over contexts of two and three words."""
    tokens = [words(t) for t in texts]
    log, _ = spelling(tokens)
    root = {w: 2.0 ** log(w) for w in {"", *(w for t in tokens for w in t)}}
    at = [([None] * 3 + t + [""], i) for t in tokens for i in range(3, len(t) + 4)]
    seen = {2: defaultdict(Counter), 3: defaultdict(Counter)}
    for s, i in at:
        for d in (2, 3):
            seen[d][tuple(s[i - d : i])][s[i]] += 1
    dist, kept = {}, set()
    for d in (2, 3):
        for ctx, c in seen[d].items():
            n, parent = sum(c.values()), root if d == 2 else dist[ctx[1:]]
            dist[ctx] = {w: (k + prior * parent[w]) / (n + prior) for w, k in c.items()}
            if n > 1 and sum(k * math.log(k / n / parent[w]) for w, k in c.items()) >= evidence:
                kept |= {ctx, ctx[1:]} if d == 3 else {ctx}
    out = []
    for t in tokens:
        s, total = [None] * 3 + t + [""], 0.0
        for i in range(3, len(s)):
            c = next((c for d in (3, 2) if (c := tuple(s[i - d : i])) in kept), None)
            total += math.log2(dist[c][s[i]] if c else root[s[i]])
        out.append((len(t) + 1, total))
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 3000, "PART": 2000}])
def test_against_brute_force(spark, data, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(P, k, v)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()}
    want = dict(zip(rows, brute(list(rows.values()))))
    got = P.score(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, log = want[r.doc_id]
        assert r.lm_symbols == n and abs(r.lm_log2 - log) < 2e-3 * n


def test_letters_against_brute_force(spark, data):
    texts = [words(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()] + [words("Привет мир 世界 𝔘 naïve x_1")]
    log, kept = spelling(texts)
    count = Counter(w for t in texts for w in [*t, ""])
    codes, starts = P.spell(list(count))
    n = np.repeat(list(count.values()), np.diff(np.append(starts, len(codes))))
    tree = P.LetterTree(*P._reduce(codes, n))
    assert len(tree.contexts) == len(kept) > 50
    assert np.allclose((2.0**tree.logp).sum(axis=1), 1, atol=1e-4)
    some = [*list(count)[:300], "мир", "𝔘", "unseen", "界"]
    assert np.abs(-tree.steps(some).astype(float) / 4 - [log(w) for w in some]).max() <= 0.25


def test_part_of_a_frequent_pair():
    """A pair that is no state: its contexts of three words stand on the spelling."""
    pair, third, word = np.zeros(6, np.uint32), np.array([1, 1, 1, 2, 2, 3], np.uint16), np.array([5, 5, 5, 6, 7, 5], np.uint32)
    got = P.part_scores(pair, third, word, np.full(6, -30.0), False, 25.0, 1.0)
    assert np.allclose(2 ** got[:3], 3 / 4, atol=1e-6) and got[5] == -30 and np.allclose(2 ** got[3:5], 1 / 3, atol=1e-6)


def test_frequent_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "FREQUENT", 20)
    rows = [(i, f"a b c{i % 3} the quick brown fox number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(P.gathered(docs)[2]) > 3
    low, own = P.score(docs).agg({"lm_bits": "max", "doc_id": "count"}).first(), brute([t for _, t in rows])
    assert max(low) == 60 and min(-b / n for n, b in own) < 3


@pytest.mark.parametrize("limits", [{"FREQUENT": 5}, {"FREQUENT": 0, "BLOCK": 3000}])
def test_scores_do_not_depend_on_what_is_frequent(spark, data, monkeypatch, limits):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    rows += [rows[0], (10**6, ""), (10**6 + 1, rows[1][1])]
    docs = spark.createDataFrame([*rows, (10**6 + 2, None)], "doc_id long, text string")
    before = sorted(map(tuple, P.score(docs, columns=["doc_id"]).collect()))
    for k, v in limits.items():
        monkeypatch.setattr(P, k, v)
    assert len(P.gathered(docs)[2]) > 20
    after = sorted(map(tuple, P.score(docs, columns=["doc_id"]).collect()))
    assert after.pop() == before.pop() == (10**6 + 2, None, None, None)
    want = dict(zip((i for i, _ in rows), brute([t for _, t in rows])))
    for (i, n, old, _), (j, m, new, _) in zip(before, after, strict=True):
        assert (i, n) == (j, m) and m == want[i][0] and abs(old - new) < 1e-6 * n and abs(new - want[i][1]) < 2e-3 * n


def test_documents_that_occur_twice_score_apart(spark, data):
    """And more text makes a larger tree: nothing is folded or capped."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars between 600 and 4000").dropDuplicates(["text"]).limit(80)
    both = docs.select("doc_id", "text").unionByName(docs.where("doc_id % 4 = 0").selectExpr("doc_id + 1000000 as doc_id", "text"))
    got = {r.doc_id: r.lm_bits for r in P.score(both).collect()}
    twice, once = [b for i, b in got.items() if i % 4 == 0], [b for i, b in got.items() if i % 4]
    assert max(twice) < 2 and np.median(once) > 8 and np.quantile(once, 0.25) > max(twice), np.quantile(once, [0.1, 0.25, 0.5])  # some are near copies, or one line repeated


def test_scripts_are_kept_apart(spark):
    """Texts of the same word lengths in another script, and gibberish of the same letters, score worse."""
    rows = [(i, "мой дом и мой сад где растут белые розы") for i in range(30)] + [(100, "мой дом и мой сад где растут белые розы"), (101, "τοι ναι ο και ενα μια τωρασα εδωτω πολυ"), (102, "омй мдо и йом дас едг туртас еылеб ызор")]
    got = {r.doc_id: r.lm_bits for r in P.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] + 3 < min(got[101], got[102])


def test_edges(nasty, none):
    out = P.score(nasty)
    assert out.columns == [c for c in nasty.columns if c != "lm_bits"] + ["lm_symbols", "lm_log2", "lm_bits"]
    rows = out.collect()
    assert len(rows) == nasty.count()
    got = {(r.doc_id, r.text): r for r in rows}
    assert got[5, None].lm_bits is None and got[4, ""].lm_symbols == 1 and got[7, got_text(got, 7)].lm_symbols == 60_001
    assert len({r.lm_log2 for r in rows if r.doc_id == 1}) == 1
    assert P.score(none).count() == 0


def got_text(got, i):
    return next(t for k, t in got if k == i)
