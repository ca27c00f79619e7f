import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitequarry.llm import mixing as M
from sitequarry.llm import sharding as S


def tokens(t):
    return len(re.findall(r"[^ \t\r\n]+", t or ""))


def draw(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32


def copies(rows, alpha=M.ALPHA):
    """By the closed form: one column of constraints."""
    n = defaultdict(int)
    for _, t, s in rows:
        n[s] += tokens(t)
    live = {s: v for s, v in n.items() if v}
    scale = sum(live.values()) / sum(v**alpha for v in live.values()) if live else 0
    rate = {s: round(live[s] ** alpha * scale / live[s], 9) if s in live else 1.0 for s in n}
    return [(i, s, rate[s], int(rate[s]) + (draw(i) < rate[s] - int(rate[s]))) for i, _, s in rows]


def test_against_closed_form(nasty, none):
    rows = [(r.doc_id, r.text, r.source) for r in nasty.collect()]
    got = M.mix(nasty)
    assert got.columns == [c for c in nasty.columns if c not in ("rate", "copies")] + ["rate", "copies"]
    key = lambda r: repr(r)
    assert sorted([(r.doc_id, r.source, r.rate, r.copies) for r in got.collect()], key=key) == sorted(copies(rows), key=key)
    assert M.mix(none).count() == M.mixed(none).count() == 0
    out = M.mixed(nasty)
    assert out.columns == nasty.columns and out.count() == sum(c for *_, c in copies(rows))


def test_newton_on_the_dual_of_one_column(spark, data, monkeypatch):
    """The query's multipliers, and those for targets of one column, are what Newton's method finds."""
    tokens_of, goal = 10.0 ** np.arange(-20, 21), 10.0 ** np.roll(np.arange(-20, 21), 7)
    lam = M.newton(tokens_of, goal)
    assert np.abs(tokens_of * np.exp(lam) / goal - 1).max() < 1e-12 and np.abs(lam - np.log(goal / tokens_of)).max() < 1e-12
    rows = [(i, "word " * (1 + i % 7), f"s{i % 5}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(tuple(r[c] for c in ("doc_id", "source", "rate", "copies")) for r in M.mix(docs).collect()) == sorted(copies(rows))
    with pytest.raises(ValueError):
        M.newton(tokens_of, goal, rounds=5)
    cells = spark.createDataFrame([("a", 10), ("b", 1000), (None, 7), ("empty", 0)], "source string, tokens long")
    monkeypatch.setattr(M, "newton", lambda t, g, *_: np.full(len(t), 7.0))
    assert M.solve(cells, ["source"], {"source": {"a": 3.0, "b": 5.0}}) == {"source": {"a": 7.0, "b": 7.0}}
    got = {r.v: r.m for r in M.tempered(cells, "source", 0.7, "v", "m").collect()}
    assert got == {"a": 7.0, "b": 7.0, None: 7.0}


def test_two_columns_against_proportional_fitting(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.collect()
    cell = defaultdict(float)
    for r in rows:
        cell[r.source, r.lang] += tokens(r.text)
    total = sum(cell.values())
    sources, langs = sorted({s for s, _ in cell}), sorted({g for _, g in cell})
    want = {"source": {s: total / len(sources) for s in sources}, "lang": dict(zip(langs, total * np.array([0.3, 0.4, 0.2, 0.1])))}
    w = {k: 1.0 for k in cell}
    for _ in range(20_000):
        for axis, goal in ((0, want["source"]), (1, want["lang"])):
            now = defaultdict(float)
            for k in cell:
                now[k[axis]] += w[k] * cell[k]
            for k in cell:
                w[k] *= goal[k[axis]] / now[k[axis]]
    got = {(r.source, r.lang): r.rate for r in M.mix(docs, targets=want).collect()}
    assert max(abs(got[k] - w[k]) / w[k] for k in got) < 1e-5


def test_targets_that_cannot_be_met(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    with pytest.raises(ValueError):
        M.mix(docs, targets={"source": {"src1": -1.0}}).count()


def test_permutation():
    for n in (1, 2, 3, 5, 17, 64, 1000, 4097):
        p = S.permute(np.arange(n), n)
        assert sorted(p) == list(range(n)) and (S.permute(p, n, inverse=True) == np.arange(n)).all()
    p = S.permute(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02 and (S.permute(np.arange(100), 100, seed=1) != S.permute(np.arange(100), 100, seed=2)).any()


def test_shards(nasty, none, spark):
    got = S.shard(nasty, shards=4)
    assert got.columns == [c for c in nasty.columns if c not in ("shard", "slot", "row_number")] + ["row_number", "shard", "slot"]
    rows, n = got.collect(), nasty.count()
    assert sorted(r.row_number for r in rows) == list(range(n))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.row_number)] == sorted((r.doc_id for r in nasty.collect()), key=lambda i: (i is not None, i))
    for r in rows:
        p = int(S.permute(np.array([r.row_number]), n)[0])
        assert (r.shard, r.slot) == (p % 4, p // 4)
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(c)) for k, c in Counter(r.shard for r in rows).items())
    again = S.shard(nasty.repartition(3), shards=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert S.shard(none).count() == 0
    with pytest.raises(ValueError):
        S.shard(nasty, shards=0)


def test_more_sources_than_a_dense_hessian_takes(spark):
    rows = [(i, "word " * (1 + i % 7), f"s{i}") for i in range(3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(tuple(r[c] for c in ("doc_id", "source", "rate", "copies")) for r in M.mix(docs).collect()) == sorted(copies(rows))
    got = {r.source: r.rate for r in M.mix(docs, targets={"source": {f"s{i}": 3.0 for i in range(3100)}}).collect()}
    assert all(abs(got[s] - 3 / len(t.split())) < 1e-8 for _, t, s in rows)


def test_conjugate_gradients_step_as_the_dense_hessian(spark, monkeypatch):
    rows = [(i, "word " * (3 + i), f"s{i % 2}", f"g{i % 3}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want = {"source": {"s0": 15.0, "s1": 18.0}, "lang": {"g0": 12.0, "g1": 11.0, "g2": 10.0}}
    dense = {r.doc_id: r.rate for r in M.mix(docs, targets=want).collect()}
    monkeypatch.setattr(M, "MOST", 2)
    assert all(abs(dense[r.doc_id] - r.rate) < 1e-6 for r in M.mix(docs, targets=want).collect())
