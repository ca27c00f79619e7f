import pytest

from sitequarry.llm import decontaminate as D

from .conftest import tokens, word_spans

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
FILL = " ".join(f"clean{i}" for i in range(60))


def brute(text, items, n=D.N, shortest=D.SHORTEST, share=D.DROP_SHARE):
    """Token by token; None if the document goes."""
    known = set()
    for item in items:
        w = tokens(item)
        if m := min(n, len(w)):
            known |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    if text is None:
        return None, False
    gone, total = 0, len(tokens(text))
    while True:
        spans, bad = word_spans(text), set()
        for k in {len(g) for g in known if len(g) >= shortest}:
            for i in range(len(spans) - k + 1):
                if tuple(s[2] for s in spans[i : i + k]) in known:
                    bad |= set(range(i, i + k))
        line = [text.count("\n", 0, s[0]) for s in spans]
        for one in set(line):
            own = [i for i, x in enumerate(line) if x == one]
            if len(own) < shortest and tuple(spans[i][2] for i in own) in known:
                bad |= set(own)
        if not bad:
            return text, False
        gone += len(bad)
        if gone >= share * total:
            return None, True
        parts, at = [], 0
        for i in sorted(bad):
            if i - 1 not in bad:
                parts.append(text[at : spans[i][0]])
            if i + 1 not in bad:
                at = spans[i][1]
        text = " ".join(x for p in [*parts, text[at:]] if (x := p.strip()))


CHINESE = "人人生而自由在尊严和权利上一律平等他们赋有理性和良心"


def rows():
    cut = ITEM.split()
    return [
        (1, FILL), (2, f"{FILL} {ITEM.upper().replace(' ', ', ')}; {FILL}"), (3, ITEM), (4, None), (5, ""), (6, f"{FILL} {' '.join(cut[:7])} {FILL}"), (7, f"{FILL} {' '.join(cut[:5])} {ITEM} {' '.join(cut[5:])} {FILL}"),
        (8, f"{FILL} one two three four five {FILL}"), (11, f"{FILL}\nA, b!\n{FILL}"), (12, f"{FILL} a b {FILL}"), (13, "a b"), (14, f"{FILL}\na b c\n b\n"), (15, f"开头的话。{CHINESE[:12]}。{FILL}"), (16, CHINESE[5:9] + FILL),
        (17, f"{ITEM} {' '.join(FILL.split()[:12])}"), (18, f"{ITEM} {' '.join(FILL.split()[:13])}"), (None, f"{ITEM} {FILL}"), (2, f"{FILL} {ITEM.upper().replace(' ', ', ')}; {FILL}"), (9, f"{FILL} {' '.join(cut[2:10])}"), (10, (FILL + " ") * 300 + ITEM),
    ]


@pytest.mark.parametrize("size", [D.BROADCAST_BYTES, 600])
def test_against_brute_force(spark, size):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "x", 1) for i, t in rows()], "doc_id long, text string, n_chars long, hash string, h int")
    items = [ITEM, "one two three four five", "a b", None, "", ITEM, CHINESE]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = D.decontaminate(docs, bench, broadcast_bytes=size)
    assert got.columns == docs.columns
    want = sorted((repr(i), repr(new)) for i, t in rows() for new, dropped in [brute(t, items)] if not dropped)
    have = got.collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in have) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in have)


def test_whole_table(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    want = {r.doc_id: new for r in docs.collect() for new, dropped in [brute(r.text, items)] if not dropped}
    assert {r.doc_id: r.text for r in D.query(spark, data).collect()} == want


def test_whole_table_by_a_join(spark, data, monkeypatch):
    """A set that may not be broadcast; also with a filter that lets everything through. Texts move only where there is a hit."""
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want = sorted(map(tuple, D.decontaminate(docs, bench).collect()))
    assert sorted(map(tuple, D.decontaminate(docs, bench, broadcast_bytes=0).collect())) == want
    from sitequarry.llm.common import IdFilter

    monkeypatch.setattr(IdFilter, "MOST_BITS", 64)
    some = docs.where("doc_id < 20")
    assert sorted(map(tuple, D.decontaminate(some, bench, broadcast_bytes=0).collect())) == [r for r in want if r[0] < 20]


def test_edges(nasty, none, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven wizards")], "item_id long, text string")
    got = D.decontaminate(nasty, bench)
    assert {r.doc_id for r in got.collect()} >= {4, 5, 6, 7, 8, 9}
    assert not any("brown fox" in (r.text or "").lower() for r in got.collect())
    assert D.decontaminate(none, bench).count() == 0
    assert D.decontaminate(nasty, bench.limit(0)).count() == nasty.count()
    assert sorted(map(repr, D.decontaminate(nasty, bench, broadcast_bytes=0).collect())) == sorted(map(repr, got.collect()))
    assert D.decontaminate(none, bench, broadcast_bytes=0).count() == 0
