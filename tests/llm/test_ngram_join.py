from collections import Counter
from itertools import combinations

import pytest

from sitequarry.llm import groups as G
from sitequarry.llm import ngram_join as J

from .conftest import tokens


def grams(text, n=J.N):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=J.THRESHOLD):
    """{(a, b): Jaccard} of all pairs of (id, text)."""
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    out = {}
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y:
            j = len(x & y) / len(x | y)
            if j >= threshold:
                p = (min(a, b), max(a, b))
                out[p] = max(out.get(p, 0), j)
    return out


def groups(rows, threshold=J.THRESHOLD):
    """Kept (id, text) of each connected group: the least id, null last."""
    rows = list(dict.fromkeys(rows))
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            parent[find(a)] = find(b)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if r not in best or (d is None, d or 0) < (rows[best[r]][0] is None, rows[best[r]][0] or 0):
            best[r] = i
    return {rows[i] for i in best.values()}


def classes(rows, threshold=J.THRESHOLD):
    """The join's rows of (id, text), by comparing every pair of n-gram sets."""
    own = {(i, frozenset(grams(t))) for i, t in rows if i is not None}
    sets = sorted({s for _, s in own if s}, key=sorted)
    similar = {s: [x for x in sets if x != s and len(s & x) / len(s | x) >= threshold] for s in sets}
    group = {}
    for s in sets:
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = s
                todo += similar[x]
    least, copies = {}, Counter(s for _, s in own)
    for i, s in own:
        if s:
            least[group[s]] = min(i, least.get(group[s], i))
    return sorted((i, least[group[s]], copies[s], len(similar[s])) if s else (i, i, 1, 0) for i, s in own)


def joined(df, **how):
    return sorted(tuple(r) for r in J.ngram_jaccard_join(df, **how).select("doc_id", "class_id", "copies", "links").collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 700")
    want = classes([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[3] > 0 for r in want) > 50
    assert joined(docs) == want


def pairs(rows):
    """Together in a class."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[0])
    return {p for ids in by.values() for p in combinations(sorted(ids), 2)}


def test_near_threshold_recall(spark):
    """Pairs of random similarity around and above the threshold, one group each."""
    import random

    r = random.Random(3)
    rows, i = [], 0
    for k in range(150):
        w = [f"w{k}x{j}" for j in range(120)]
        v = [x if r.random() > (k % 15) / 100 else f"z{r.random()}" for x in w]
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
        i += 2
    want = set(brute(rows))
    got = pairs(joined(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got <= want and len(got) >= 0.93 * len(want) > 80


def test_edges(spark, nasty, none):
    got = joined(nasty)
    assert got == classes([(r.doc_id, r.text) for r in nasty.collect()])
    assert (4, 4, 1, 0) in got and (5, 5, 1, 0) in got and sum(r[0] == 9 for r in got) == 2 and not any(r[0] is None for r in got)
    assert J.ngram_jaccard_join(none).count() == 0
    assert J.drop_near_duplicates(none).count() == 0


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "One, two, three: four!"), ("c", ""), (None, "one two three four")]
    assert joined(spark.createDataFrame(rows, "doc_id string, text string")) == [("a", "a", 2, 0), ("b", "a", 2, 0), ("c", "c", 1, 0)]


def near_copies(many, seed=1):
    """Versions of one text, each with changes of its own, and some strange texts among them that share its rare words."""
    import random

    r = random.Random(seed)
    base = [f"w{j}" for j in range(80)]
    out = [(k, " ".join(x if r.random() > 0.04 else f"v{k}x{j}" for j, x in enumerate(base))) for k in range(many)]
    out += [(many + k, " ".join(base[:40] + [f"s{k}x{j}" for j in range(40 + k)])) for k in range(many // 10)]
    return out


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 16, "BLOCK_MEMBERS": 32}, {"BLOCK_GRAMS": 500}])
def test_large_groups_are_dealt_over_tasks(spark, monkeypatch, limits):
    """Hot buckets and blocks of a large group give what one task gives."""
    for k, v in limits.items():
        monkeypatch.setattr(J if hasattr(J, k) else G, k, v)
    rows = near_copies(150) + [(1000 + k, " ".join(f"c{k + j}" for j in range(40))) for k in range(0, 300, 6)]  # and a long chain
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == classes(rows)


def test_no_text_in_a_shuffle(nasty, monkeypatch):
    """Whatever may be broadcast; the result doesn't depend on it."""
    from sitequarry.llm.common import IdFilter

    want = sorted(map(repr, J.drop_near_duplicates(nasty).collect()))
    planned = []
    table = J.Workspace.table
    monkeypatch.setattr(J.Workspace, "table", lambda self, df, name: planned.append(df) or table(self, df, name))
    for bits in (IdFilter.MOST_BITS, 64):
        monkeypatch.setattr(IdFilter, "MOST_BITS", bits)
        J.ngram_jaccard_join(nasty).collect()
        for df in planned:
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
                assert "Exchange" not in line or "text#" not in line, plan
    assert sorted(map(repr, J.drop_near_duplicates(nasty).collect())) == want


def test_id_filter(spark):
    from sitequarry.llm.common import IdFilter

    ids = spark.range(5000).selectExpr("id as h", "id * 7 as g")
    f = IdFilter(ids.where("h < 2000"), 2000)
    rows = ids.select("h", *(c.alias(f"p{k}") for k, c in enumerate(IdFilter.places(*(ids[c] for c in "hg"))))).toPandas()
    hit = f.holds([rows[f"p{k}"].to_numpy() for k in range(IdFilter.HASHES)])
    assert hit[rows.h < 2000].all() and hit[rows.h >= 2000].mean() < 0.05


def test_equal_rows_and_clashing_names(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "", None, 3), (2, "", None, 3), (3, "p q r s", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __uid string, H long").repartition(3)
    got = J.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted(map(tuple, got.collect()), key=repr)
    assert [r[0] for r in kept] == [1, 2, 3] and kept[0] in rows and kept[1:] == [(2, "", None, 3), (3, "p q r s", None, None)]


def test_dedup_keeps_one_of_each_group(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    kept = J.drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == groups(rows)


def test_prefixes_are_shortened_to_the_target():
    p = J.least_length(J.THRESHOLD, J.TREES, J.DEPTH, J.TARGET)
    assert J.meeting_probability(J.THRESHOLD, J.TREES, p) >= J.TARGET > J.meeting_probability(J.THRESHOLD, J.TREES, p + 1)
    assert J.least_length(1.0, 1, 4, 0.95) == 4 and J.least_length(0.01, 2, 4, 0.95) == 1


def test_shared_counts():
    import numpy as np

    r = np.random.default_rng(4)
    for m in (3, 40, 300):
        sets = [np.unique(r.integers(0, 500, r.integers(1, 90))).astype(np.uint64) for _ in range(m)]
        want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
        for got in (J._shared(sets), J._shared(sets, most=7)):
            assert (got == want)[~np.eye(m, dtype=bool)].all()


def test_sketches_say_jaccard_at_any_length():
    import numpy as np

    r, (a, b) = np.random.default_rng(5), J._hashers(480)
    for length in (300, 1000, 5000):
        for jaccard in (0.0, 0.5, 0.6):
            same = round(2 * length * jaccard / (1 + jaccard))
            g = r.integers(0, 2**64, 2 * length - same, np.uint64)
            x, y = (J.mixed_bytes(J.minhash(s, a, b)) for s in (g[:length], g[length - same :]))
            assert abs(J._similar(x, y) - jaccard) < 0.1


def test_a_hot_group_does_not_hide_small_ones(spark):
    """Pairs just above the threshold, beside a group of near copies."""
    rows = [(k, " ".join(f"h{j}" if j != k % 120 else f"x{k}" for j in range(120))) for k in range(200)]
    for k in range(100):
        rows += [(1000 + 2 * k + side, " ".join(f"p{k}x{j}" if j < 84 else f"p{k}x{j}s{side}" for j in range(120))) for side in (0, 1)]
    got = pairs([r for r in joined(spark.createDataFrame(rows, "doc_id long, text string")) if r[0] >= 1000])
    assert got <= {(1000 + 2 * k, 1001 + 2 * k) for k in range(100)} and len(got) >= 95


def test_links_are_components_of_similar_sketches():
    import numpy as np

    r = np.random.default_rng(2)
    base = r.integers(0, 256, (6, J.SKETCH), np.uint8)
    own = np.repeat(np.arange(6), 20)
    x = base[own]
    x[np.arange(120), r.integers(0, J.SKETCH, 120)] ^= 1
    label = J._link(x, 0.4)
    assert (label == own * 20).all()
