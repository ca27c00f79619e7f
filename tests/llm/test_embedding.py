from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sitequarry.llm import embedding_dedup as E
from sitequarry.llm import groups as G


def brute(rows, t=E.THRESHOLD):
    """(id, class, copies, links) by comparing every pair of (id, vector)."""
    unit = {}
    for i, v in rows:
        v = np.array([np.nan if x is None else x for x in v] if v is not None and len(v) else [], float)
        with np.errstate(all="ignore"):
            v = tuple((v / np.sqrt((v * v).sum())).astype(np.float32).tolist())
        if i is not None:
            unit.setdefault(i, set()).add(v if len(v) and np.isfinite(v).all() else None)
    own = [(i, v) for i, vs in unit.items() for v in vs]
    kinds = list({v for _, v in own if v is not None})
    near = {v: [w for w in kinds if w != v and len(w) == len(v) and np.dot(v, w) >= t] for v in kinds} if len(kinds) < 60 else fast(kinds, t)
    group = {}
    for v in kinds:
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = v
                todo += near[x]
    least = {}
    for i, v in own:
        if v is not None:
            least[group[v]] = min(i, least.get(group[v], i))
    copies = Counter(v for _, v in own)
    return sorted((i, least[group[v]], copies[v], len(near[v])) if v is not None else (i, i, 1, 0) for i, v in own)


def fast(kinds, t):
    x = np.array(kinds)
    hit = x @ x.T >= t
    np.fill_diagonal(hit, False)
    return {v: [kinds[j] for j in np.flatnonzero(row)] for v, row in zip(kinds, hit)}


def found(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in E.near_duplicates(df).select("vec_id", "class_id", "copies", "links").collect())


def linked(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[0])
    return {(min(p), max(p)) for g in by.values() for p in combinations(g, 2)}


@pytest.mark.parametrize("noise", [0.01, 0.035, 0.045])
def test_recall(spark, noise):
    r = np.random.default_rng(1)
    base = r.standard_normal((150, 64))
    x = np.concatenate([base, base[:100] + 8 * noise * r.standard_normal((100, 64)), base[:1] + 0.02 * r.standard_normal((40, 64))]).astype(np.float32)
    rows = list(enumerate(x))
    want, got = brute(rows), found(spark, rows)
    assert linked(got) <= linked(want) and len(linked(got)) >= 0.9 * len(linked(want)) > 700
    assert sum(r[3] for r in got) >= 0.9 * sum(r[3] for r in want)


def test_many_copies_and_hot_buckets(spark, monkeypatch):
    """5,000 copies of one vector cost one; near copies in buckets dealt over tasks and in blocks give what one task gives."""
    r = np.random.default_rng(3)
    base = r.standard_normal(32)
    rows = [(i, base) for i in range(5000)] + [(10_000 + i, base + 0.08 * r.standard_normal(32)) for i in range(150)] + [(20_000 + i, v) for i, v in enumerate(r.standard_normal((60, 32)))]
    rows = [(i, np.asarray(v, np.float32)) for i, v in rows]
    want = brute(rows)
    assert want[0][:3] == (0, 0, 5000) and want[0][3] > 100
    got = found(spark, rows)
    assert got == want
    monkeypatch.setattr(G, "BUCKET", 20)
    monkeypatch.setattr(G, "BLOCK_MEMBERS", 32)
    assert found(spark, rows) == want


def test_given_table(spark):
    """All vectors of the table, against every pair; and with planted near copies."""
    x = [(r.vec_id, np.array(r.embedding, np.float32)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert found(spark, x) == brute(x)
    r = np.random.default_rng(9)
    more = x + [(100_000 + i, v + np.float32(0.02) * np.abs(v).mean() * r.standard_normal(len(v)).astype(np.float32)) for i, v in x[::5]]
    assert found(spark, more) == brute(more) and sum(q[3] > 0 for q in brute(more)) >= 200


def test_hadamard_keeps_lengths_and_inverts():
    x = np.random.default_rng(0).standard_normal((5, 16)).astype(np.float32)
    y = E.fast_hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), atol=1e-4)
    assert np.allclose(E.fast_hadamard(y), x, atol=1e-5)


def test_edges(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0]), (9, [5.0]),
        (10, [0.0, 1.0, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [-1.0, 0.0, 0.0]), (12, [float("inf"), 0.0, 0.0]), (13, [3e38, -0.0, 0.0]),
    ]
    t = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, key string, component int")
    got = sorted(tuple(r) for r in E.near_duplicates(t).collect())
    assert got == brute(rows)
    assert (1, 1, 3, 1) in got and (9, 8, 2, 0) in got and (5, 5, 1, 0) in got and [r[1] for r in got if r[0] == 10] == [1, 10]
    assert E.near_duplicates(t.limit(0)).count() == 0
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1])], "vec_id string, embedding array<double>")
    assert sorted(tuple(r) for r in E.near_duplicates(named).collect()) == [("a", "a", 1, 1), ("b", "a", 1, 1)]
