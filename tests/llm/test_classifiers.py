import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sitequarry.llm import language_id as L
from sitequarry.llm import quality as Q
from sitequarry.llm import toxicity as T
from sitequarry.llm import url_filter as U
from sitequarry.llm.common import TokenHash, labelled_sample, mix64

from .conftest import tokens

TABLES = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    return docs.join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").orderBy("doc_id").collect()


# == language


def test_kernel_is_the_blended_spectrum_kernel():
    texts = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "el perro y el gato"]
    m = L.Model(texts, ["de", "en", "fr", "es"], 4, 0.01)
    p = L.Presence(m.alphabet)

    def grams(t):
        s = " " + t + " "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}

    row, count = p.of("the cat et le chat", m.columns)
    mine = grams("the cat et le chat")
    assert count == len(mine)
    kernel = row.astype(float) @ m.marks / np.sqrt(count)
    for k, t in zip(kernel, sorted(texts, key=lambda t: ["de", "en", "es", "fr"].index({"der": "de", "the": "en", "el": "es", "le": "fr"}[t.split()[0]]))):
        assert abs(k - len(mine & grams(t)) / np.sqrt(len(mine) * len(grams(t)))) < 1e-5


def test_language_held_out(labelled):
    rows = [r for r in labelled if len(r.text) > 30]
    train, test = rows[::10][:300], rows[1::5]
    m, p = L.Model([r.text for r in train], [r.lang for r in train], L.LANDMARKS, L.RIDGE), None
    p = L.Presence(m.alphabet)
    got = [p.of(r.text, m.columns) for r in test]
    best = m.scores(np.stack([g[0] for g in got]), np.array([g[1] for g in got])).argmax(axis=1)
    assert np.mean([m.langs[b] == r.lang for b, r in zip(best, test)]) > 0.98


def gram_set(text, alphabet):
    """1- to 3-grams of letters with a gap at both ends of each run; a letter outside the alphabet is '?'."""
    table = {chr(c) for c in alphabet}
    s = "".join(x if (x := c.lower()[0]) in table else "?" if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text or "")
    s = " " + " ".join(s.split()) + " " if s.split() else "  "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" ", "  "}


def plain_language_model(rows, landmarks):
    """Kernel by sets, Nystrom map by the pseudo-inverse root, ridge as an augmented least-squares system: (scores, shares) of a text."""
    alphabet = sorted({ord(x) for t, _ in rows for c in t if c.isalpha() for x in c.lower()[0]})
    langs = sorted({g for _, g in rows})
    sets = [gram_set(t, alphabet) for t, _ in rows]
    marks = []
    for lang in langs:
        own = [i for i, (_, g) in enumerate(rows) if g == lang and sets[i]]
        marks += sorted(own, key=lambda i: (-len(sets[i]), rows[i][0]))[: max(1, landmarks // len(langs))]
    k = lambda x, y: len(x & y) / np.sqrt(max(1, len(x)) * len(y))
    mm = np.array([[k(sets[i], sets[j]) for j in marks] for i in marks])
    e, v = np.linalg.eigh(mm)
    root = v[:, e > 1e-6 * e.max()] / np.sqrt(e[e > 1e-6 * e.max()])
    phi = lambda s: np.append(np.array([k(s, sets[j]) for j in marks]) @ root, 1.0)
    x, y = np.stack([phi(s) for s in sets]), np.array([[1.0 if g == h else -1.0 for h in langs] for _, g in rows])
    b = np.sqrt([1 / sum(g == h for _, h in rows) for _, g in rows])[:, None]
    penalty = np.sqrt(L.RIDGE * len(langs)) * np.eye(x.shape[1])
    penalty[-1, -1] = np.sqrt(1e-9)
    w = np.linalg.lstsq(np.vstack([x * b, penalty]), np.vstack([y * b, np.zeros((x.shape[1], len(langs)))]), rcond=None)[0]
    known = [set().union(*(sets[i] for i in marks if rows[i][1] == g)) for g in langs]

    def judged(text):
        s = gram_set(text, alphabet)
        return (phi(s) @ w, np.array([len(s & q) / max(1, len(s)) for q in known]), len(s)) if s else (None, None, 0)

    return langs, judged


def test_language_against_brute_force(spark, data):
    """Kernel, Nystrom features, ridge regression and decision, over all documents."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = L.training_rows(docs, 20)
    langs, judged = plain_language_model(rows, 16)
    out = L.identify(docs, L.train(docs, per_language=20, landmarks=16)).collect()
    assert len(out) == docs.count()
    for r in out:
        s, known, n = judged(r.text)
        if not n:
            assert (r.lang_pred, r.lang_ok) == ("und", False)
            continue
        best, lead = int(np.argmax(s)), float(np.diff(np.sort(s))[-1])
        assert abs(r.lang_score - s[best]) < 2e-3 and abs(r.lang_margin - lead) < 4e-3
        if lead > 4e-3:
            assert r.lang_pred == langs[best] and abs(r.lang_known - known[best]) < 1e-5
            if abs(lead - L.MARGIN) > 4e-3 and abs(known[best] - L.KNOWN) > 1e-5:
                assert r.lang_ok == (lead >= L.MARGIN and known[best] >= L.KNOWN)


SAYINGS = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Кожна людина має право на життя, на свободу і на особисту недоторканність. Ніхто не повинен бути в рабстві або у підневільному стані",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه. لا يجوز استرقاق أو استعباد أي شخص ويحظر الاسترقاق وتجارة الرقيق بكافة أوضاعهما",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有资格享受本宣言所载的一切权利和自由。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है",
}


def test_scripts_and_strangers(spark):
    """Languages of many scripts, two of them sharing one; languages outside the labels and random letters are not identified."""
    import random

    rows = []
    for lang, t in SAYINGS.items():
        step = max(1, len(t) // 12)
        rows += [(t[i : i + 3 * step], lang) for i in range(0, len(t) - step, step)] * 2
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    m = L.train(docs)
    assert L.Presence(m.alphabet).seen is None
    r = random.Random(1)
    mash = " ".join("".join(r.choice("абвгдежзийклмнопрстуфхцчшщыьэюя") for _ in range(9)) for _ in range(60))
    asked = [(1, "Каждый имеет право на свободу"), (2, "Кожна людина має право"), (3, "και τα δικαιώματα"), (4, "في الحياة والحرية"), (5, "人人有权享有自由"), (6, "すべての人間は自由である"), (7, "प्रत्येक व्यक्ति को जीवन")]
    strange = [(10, mash), (11, "All human beings are born free and equal in dignity"), (12, "모든 인간은 태어날 때부터 자유로우며"), (13, "ყველა ადამიანი იბადება თავისუფალი"), (14, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢")]
    out = {x.doc_id: x for x in L.identify(spark.createDataFrame(asked + strange, "doc_id long, text string"), m).collect()}
    assert [out[i].lang_pred for i, _ in asked] == ["ru", "uk", "el", "ar", "zh", "ja", "hi"] and all(out[i].lang_ok for i, _ in asked)
    assert not any(out[i].lang_ok for i, _ in strange)


def test_strangers_to_the_tables(labelled):
    """The given tables' languages: Italian, Polish and Finnish prose, base64 and typing at random are not identified, theirs is."""
    rows = [r for r in labelled if len(r.text) > 30][::10][:600]
    m = L.Model([r.text for r in rows], [r.lang for r in rows], L.LANDMARKS, L.RIDGE)
    p = L.Presence(m.alphabet)
    strange = [
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.", "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saaani sanelemahan, sukuvirttä suoltamahan.",
        "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgc3RyaW5nIHdpdGggYmFzZTY0IGVuY29kaW5n", "xkqj zvwb qpfh jjkd wlkjq zxcvq wpoirz qqkj vbnxm asdkjf qwpoei zmxnb", "Привет мир, как дела",
    ]
    share = lambda texts: [float(m.shares(row[None], np.array([n])).max()) for row, n in (p.of(t, m.columns) for t in texts)]
    assert max(share(strange)) < L.KNOWN and np.mean(np.array(share([r.text for r in labelled if len(r.text) > 30])) >= L.KNOWN) > 0.999


def test_equal_scores_have_no_lead(spark):
    docs = spark.createDataFrame([(1, "abc abd", "x"), (2, "abc abd", "y")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.lang_ok) for r in L.identify(docs, L.train(docs)).collect()] == [("x", False)] * 2


def test_many_texts_under_one_id_are_a_bounded_sample(spark):
    docs = spark.range(400).selectExpr("1L as doc_id", "concat('text ', id) as text", "'en' as lang")
    assert len(L.training_rows(docs, 30)) == 30


def test_language_edges(spark, nasty, none):
    out = {(r.doc_id, r.text): r for r in L.identify(nasty, L.train(nasty)).collect()}
    assert out[5, None].lang_pred == out[4, ""].lang_pred == "und" and out[5, None].lang_ok is False and out[5, None].lang_score is None
    assert L.keep_identified(nasty).columns == nasty.columns
    assert {r.doc_id for r in L.keep_identified(nasty).collect()} >= {1, 2, 3, 7, 8, 13}
    assert L.identify(none, L.train(none)).count() == L.keep_identified(none).count() == 0
    assert L.identify(nasty, None).where("lang_pred <> 'und' or lang_ok").count() == 0
    one = spark.createDataFrame([(1, "nur deutsch", "de")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.lang_margin) for r in L.identify(one, L.train(one)).collect()] == [("de", None)]


def test_pipeline_stage_keeps_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert L.keep_identified(docs).count() >= 0.98 * docs.count()


# == quality


def test_quality_held_out(labelled):
    train, test = labelled[::2], labelled[1::2]
    m = Q.Model([r.text for r in train], [r.quality for r in train])
    ok = m.score([r.text for r in test], TokenHash()) >= Q.THRESHOLD
    y = np.array([r.quality for r in test]) > 0
    assert (ok[y]).mean() > 0.98 and (~ok[~y]).mean() > 0.9


def plain_features(text):
    """Distinct hashed words, signs and pairs of them; a repeated token is one feature."""
    t = re.findall(r"\w+|[^\w\s]+", text or "")
    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in t]
    big, fin = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def mix(x):
        x = (x ^ x >> 32) * fin & big
        x = (x ^ x >> 29) * fin & big
        return x ^ x >> 32

    return {mix(x) >> 64 - Q.BITS for x in h} | {mix(int(Q._REPEAT) if x == y else (x * 0x9E3779B97F4A7C15 + y) & big) >> 64 - Q.BITS for x, y in zip(h, h[1:])}


def test_quality_against_brute_force(spark, data):
    """Features token by token, log-count ratios by counting, a hinge loss whose dual equals its primal, and the score, over all documents."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    y = {r.doc_id: 1 if r.quality > 0 else -1 for r in labels.collect()}
    rows = [(plain_features(r.text), y[r.doc_id]) for r in docs.collect() if r.doc_id in y]
    count = {s: Counter(f for own, t in rows if t == s for f in own) for s in (1, -1)}
    seen = sorted(set(count[1]) | set(count[-1]))
    total = {s: sum(Q.SMOOTH + count[s][f] for f in seen) for s in (1, -1)}
    ratio = {f: math.log((Q.SMOOTH + count[1][f]) / total[1] / ((Q.SMOOTH + count[-1][f]) / total[-1])) for f in seen}
    place = {f: i for i, f in enumerate(seen)}
    xs = [(np.array([place[f] for f in sorted(own)], int), np.array([ratio[f] for f in sorted(own)]) / math.sqrt(max(1, len(own)))) for own, _ in rows]
    goal = np.array([float(t) for _, t in rows])
    cost = Q.COST * len(goal) / (2 * np.where(goal > 0, (goal > 0).sum(), (goal < 0).sum()))
    w, b, alpha = Q.descend(xs, goal, cost, len(seen), 400)
    primal = 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - t * (w[f] @ v + b)) for (f, v), t, c in zip(xs, goal, cost))
    dual = alpha.sum() - 0.5 * (w @ w + b * b)
    assert 0 <= primal - dual < 5e-3 * max(1.0, primal) and (alpha >= 0).all() and (alpha <= cost + 1e-12).all()
    m = Q.train(docs, labels)
    mean = np.abs(w).mean()
    for r in Q.classify(docs, m).collect():
        own = plain_features(r.text)
        got = sum(float(m.weights[f]) for f in own) / math.sqrt(max(1, len(own))) + m.bias
        assert abs(r.quality_score - got) < 1e-4 and r.quality_ok == (r.quality_score >= Q.THRESHOLD)
        want = sum(((1 - Q.BETA) * w[place[f]] + Q.BETA * mean) * ratio[f] for f in own if f in place) / math.sqrt(max(1, len(own))) + (1 - Q.BETA) * b
        assert abs(want - got) < 0.02 * max(1.0, abs(want))


def test_quality_ties_and_bounded_samples(spark):
    docs = spark.createDataFrame([(1, f"good text {i}") for i in range(300)] + [(2, f"bad words {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(labelled_sample(docs, labels.withColumnRenamed("quality", "y"), 20)) == 40
    m = Q.train(docs, labels)
    s = Q.classify(docs.limit(1), m).first().quality_score
    assert [r.quality_ok for t in (s, np.nextafter(s, 9)) for r in Q.classify(docs.limit(1), m, threshold=float(t)).collect()] == [True, False]


def test_quality_edges(spark, nasty, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 0), (13, 0), (9, 0), (None, 1), (4, None)], "doc_id long, quality int")
    out = Q.classify(nasty, Q.train(nasty, labels)).collect()
    assert {r.quality_ok for r in out if r.text is None} == {False} and all((r.quality_score is None) == (r.text is None) for r in out)
    assert Q.train(nasty, labels.where("quality = 1")) is None and Q.train(none, labels) is None
    assert Q.classify(nasty, None).where("quality_ok").count() == 0 and Q.classify(none, Q.train(nasty, labels)).count() == 0
    assert Q.classify(nasty, None).columns == [c for c in nasty.columns if c != "quality_ok"] + ["quality_score", "quality_ok"]


# == URLs


def test_url_held_out(spark):
    """By host: the table has one URL a host, and a host's kin (the same longest word) are never in both parts."""
    rows = sorted((r.url, r.label) for r in U.labelled_urls(spark).collect())
    assert len({u.split("/")[2] for u, _ in rows}) > 0.97 * len(rows) > 300 and not any(".example" in u for u, _ in rows)
    kin = {u: max(re.findall("[a-z]+|[0-9.]+", u.split("/")[2]), key=len) for u, _ in rows}
    hit = {1: [], 0: []}
    for k in range(5):
        held = lambda u: zlib.crc32(kin[u].encode()) % 5 == k  # noqa: B023, E731
        m = U.Model([u for u, _ in rows if not held(u)], [y for u, y in rows if not held(u)])
        for (u, y), p in zip([r for r in rows if held(r[0])], m.probability([u for u, _ in rows if held(u)])):
            hit[y].append(p >= U.THRESHOLD)
    assert np.mean(hit[1]) > 0.5 and np.mean(hit[0]) < 0.08, (np.mean(hit[1]), np.mean(hit[0]))


def test_url_against_brute_force(spark, data):
    """Features gram by gram, the penalised loss at its minimum, and the probability, of all pages."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    m = U.train(U.labelled_urls(spark))

    def grams(url):
        rest = re.sub(r"[?#].*", "", re.sub(r"^[a-z]+://", "", url.lower()))
        host, _, path = rest.partition("/")
        out = set()
        for kind, text in (("h", f"^{host}$"), ("p", f"^/{path}$")):
            for n in (3, 4, 5):
                for i in range(len(text) - n + 1):
                    out |= {kind + text[i : i + n], text[i : i + n]}
        return {xxhash.xxh32_intdigest(g.encode()) >> 32 - U.BITS for g in out}

    for r in U.judge(pages, m).collect():
        f = grams(r.url)
        z = math.fsum(float(m.weights[i]) for i in f) / math.sqrt(len(f)) + m.bias
        p = 1 / (1 + math.exp(-z))
        assert abs(r.url_bad - p) < 1e-5 and (abs(p - U.THRESHOLD) < 1e-5 or r.url_ok == (p < U.THRESHOLD))
    rows = [(grams(r.url), r.label) for r in U.labelled_urls(spark).collect()]
    share = sum(y for _, y in rows) / len(rows)
    slope, bias = U.RIDGE * m.weights.astype(float), 0.0
    for f, y in rows:
        i = sorted(f)
        e = (1 / (1 + math.exp(-(m.weights[i].astype(float).sum() / math.sqrt(len(f)) + m.bias))) - y) * (0.5 / share if y else 0.5 / (1 - share)) / len(rows)
        slope[i] += e / math.sqrt(len(f))
        bias += e
    assert np.abs(slope).max() < 1e-5 and abs(bias) < 1e-5


def test_url_features_are_of_host_and_path():
    a = set(U.features("https://user@Shop.example.com:8443/A/b?q=casino#bets").tolist())
    assert a == set(U.features("http://shop.example.com/a/B").tolist()) and a != set(U.features("http://shop.example.com/a").tolist())


def test_url_edges(spark):
    urls = [None, "", " ", "http://", "no url at all", "https://casino-win.example.net/x", "https://casino-win.example.net/x", "https://museum.example.org/" + "a" * 50_000, "http://münchen.de/ä"]
    t = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, url_ok string")
    m = U.train(U.labelled_urls(spark))
    out = {r.page_id: r for r in U.judge(t, m).collect()}
    assert out[0].url_bad is None and not out[0].url_ok and not out[5].url_ok and out[5].url_bad == out[6].url_bad and out[7].url_ok
    assert U.judge(t.limit(0), m).count() == 0 and U.judge(t, None).where("url_ok").count() == 0
    assert U.train(U.labelled_urls(spark).where("label = 1")) is None


def test_url_whole_table(spark, data):
    out = U.query(spark, "/root/testdata/sf0.1").collect()
    bad = [r for r in out if any(x in r.url for x in ("casino-win", "free-bets", "adult-x", "spam-farm", "ads-track"))]
    assert bad and not any(r.url_ok for r in bad)
    assert np.mean([r.url_ok for r in out if "-" not in r.url.split("/")[2]]) > 0.97


# == toxicity


def test_gradients():
    r = np.random.default_rng(0)
    net = T.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(float)
    tokens = [f"w{i}x" for i in range(9)]
    x, parts = net.inputs(tokens, TokenHash())
    at, mask, y, w = r.integers(0, 9, (6, 4)), np.arange(6)[:, None] < np.array([6, 3, 5, 6])[None], np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 0.5])
    g = net.gradients(at, x, parts, mask, y, w)

    def loss():
        xs = net.inputs(tokens, TokenHash())[0][at]
        z = net.forward({s: xs @ net.p[f"W{s}"] + net.p[f"b{s}"] for s in "fb"}, mask)
        return float(np.mean(w * (np.log1p(np.exp(z)) - y * z)))

    for k in net.p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep, e = net.p[k][i], 1e-3
        net.p[k][i] = keep + e
        up = loss()
        net.p[k][i] = keep - e
        down = loss()
        net.p[k][i] = keep
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-3 * max(1e-3, abs(g[k][i])) + 1e-6, k


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        w = T.windows(n)
        assert set().union(*[range(s, min(n, s + T.WIDTH)) for s in w]) == set(range(n))
        assert all(b - a <= T.STRIDE for a, b in zip(w, w[1:])) and (n <= T.WIDTH or w[-1] + T.WIDTH == n)


def plain_scores(net, text):
    """Of each window, word by word and gate by gate."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, T.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def entry(word):
        marked = f"^{word}$"
        grams = []
        for n in T.ORDERS:
            for i in range(len(marked) - n + 1):
                x = ord(marked[i])
                for c in marked[i + 1 : i + n]:
                    x = (x * 0x100000001B3 + ord(c)) % 2**64
                grams.append(int(mix64(np.array([(x + n) % 2**64], np.uint64))[0]) >> 64 - T.CHAR_BITS)
        return np.concatenate([p["word"][xxhash.xxh3_64_intdigest(word.encode()) >> 64 - T.WORD_BITS], p["char"][grams].mean(axis=0)])

    def read(xs, side):
        state, out = np.zeros(h), []
        for x in xs:
            a, y = x @ p[f"W{side}"] + p[f"b{side}"], state @ p[f"U{side}"]
            r, z = sig(a[:h] + y[:h]), sig(a[h : 2 * h] + y[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * (y[2 * h :] + p[f"q{side}"]))
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    t, out = tokens(text), []
    xs = {w: entry(w) for w in set(t)}
    starts = sorted({*range(0, len(t) - net.width, net.stride), max(0, len(t) - net.width)}) if t else []
    for s in starts:
        own = [xs[w] for w in t[s : s + net.width]]
        both = np.array([np.concatenate(x) for x in zip(read(own, "f"), read(own[::-1], "b")[::-1])])
        e = np.exp(np.tanh(both @ p["A"] + p["a"]) @ p["v"])
        out.append(float(sig((e / e.sum()) @ both @ p["w"] + p["c"][0])))
    return out


@pytest.mark.parametrize("stride", [T.STRIDE, 5])
def test_toxicity_against_brute_force(spark, data, stride):
    """Every window of every document, with a network trained on some."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where(f"doc_id % {1 if stride == T.STRIDE else 5} = 0")
    rows = docs.collect()
    net = T.fit([r.text for r in rows[:40]], [i % 2 for i in range(40)], rounds=1, steps=30, stride=stride)
    for r in T.score(docs, net, threshold=0.5).collect():
        p = plain_scores(net, r.text)
        assert r.toxic_windows == len(p)
        if p:
            assert abs(r.toxic_score - max(p)) < 1e-4 and (abs(max(p) - 0.5) < 1e-4 or r.toxic == (max(p) >= 0.5))


def test_toxicity_score_of_the_threshold(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    net = T.Network(4)
    s = T.score(docs, net).first().toxic_score
    assert [T.score(docs, net, threshold=float(t)).first().toxic for t in (s, np.nextafter(s, 1))] == [True, False]


def test_batches_do_not_change_scores(labelled):
    net = T.Network(3)
    texts = [T.words(r.text) for r in labelled[:60]]
    together, alone = T.Reader(net).score(texts), [T.Reader(net).score([t])[0] for t in texts]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, alone))


def test_toxicity_held_out(labelled):
    tox, fine = [r for r in labelled if r.toxic], [r for r in labelled if not r.toxic]
    """Half of these 448 toxic documents is a small sample for four languages; the check tables' 1500 give a recall of 1."""
    net = T.fit([r.text for r in tox[::2] + fine[:1500]], [1] * len(tox[::2]) + [0] * 1500)
    score = lambda rows: np.array([p.max() if len(p) else 0 for p in T.Reader(net).score([T.words(r.text) for r in rows])])
    assert (score(tox[1::2]) >= T.THRESHOLD).mean() > 0.75 and (score(fine[1500:2700]) >= T.THRESHOLD).mean() < 0.02


def test_toxicity_edges(spark, nasty, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (9, 1), (13, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    net = T.train(nasty, labels)
    out = {(r.doc_id, r.text): r for r in T.score(nasty, net).collect()}
    assert out[5, None].toxic_windows == out[4, ""].toxic_windows == 0 and out[4, ""].toxic_score is None and out[4, ""].toxic is False
    assert T.train(nasty, labels.where("toxic = 0")) is None and T.train(none, labels) is None
    assert T.score(none, net).count() == 0 and T.score(nasty, None).where("toxic").count() == 0
    assert T.score(nasty, net).columns == [c for c in nasty.columns if c != "toxic"] + ["toxic_windows", "toxic_score", "toxic"]
