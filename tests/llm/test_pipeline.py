import numpy as np

import corpus_pipeline as C
from sitequarry.llm import language_id as L
from sitequarry.llm import sharding as S

from .test_decontaminate import brute as clean
from .test_mixing_sharding import copies
from .test_ngram_join import groups


def test_against_brute_force(spark, data):
    """Each stage by plain Python over all rows; the language model is fitted by the operator and applied text by text."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    model = L.train(docs)
    p = L.Presence(model.alphabet)

    def identified(t):
        row, n = p.of(t, model.columns)
        s = model.scores(row[None], np.array([n]))[0]
        return n > 0 and model.shares(row[None], np.array([n]))[0][s.argmax()] >= L.KNOWN and np.diff(np.sort(s))[-1] >= L.MARGIN

    rows = [r for r in rows if identified(r[1])]
    kept = groups([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if (r[0], r[1]) in kept]
    rows = [(r[0], new, r[2], r[3], len(new)) for r in rows for new, dropped in [clean(r[1], items)] if not dropped]
    n = {(i, s): c for i, s, _, c in copies([(r[0], r[1], r[3]) for r in rows])}
    rows = sorted((r for r in rows for _ in range(n[r[0], r[3]])), key=lambda r: r[0])
    place = S.permute(np.arange(len(rows)), len(rows))
    want = sorted((*r, i, int(q) % S.SHARDS, int(q) // S.SHARDS) for i, (r, q) in enumerate(zip(rows, place)))
    assert sorted(map(tuple, C.run(spark, data).collect())) == want


def test_stages(spark, nasty, none, data):
    assert [name for name, _ in C.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "feistel_sharding"]
    for k, (_, stage) in enumerate(C.STAGES):
        for docs in (nasty, none):
            out = stage(spark, docs, data)
            out.collect()
            if k < 4:
                assert out.columns == docs.columns
