"""The interface end to end, over sites in memory."""

import gzip
import io
import tarfile

import pytest

from sitequarry import api, limits, report
from sitequarry.limits import PageBudget
from sitequarry.operators import robots as RB
from sitequarry.plans.expand import _Node, _Replay
from sitequarry.rulesets import Context, Ruleset, gsc_submission
from sitequarry.sources import http as H
from sitequarry.sources import raw, xmltree
from sitequarry.sources import documents as S
from sitequarry.plans.validate import validate
from sitequarry.storage import Workspace
from sitequarry.streaming.ingest import watch

NS = f'xmlns="{xmltree.CORE}"'


def urlset(*locs, extra=""):
    return f"<urlset {NS} xmlns:xhtml='{xmltree.XHTML}' xmlns:image='{xmltree.IMAGE}'>{''.join(f'<url><loc>{u}</loc>{extra}</url>' for u in locs)}</urlset>".encode()


def index(*locs):
    return f"<sitemapindex {NS}>{''.join(f'<sitemap><loc>{u}</loc></sitemap>' for u in locs)}</sitemapindex>".encode()


class Site:
    """A transport over a dictionary; picklable."""

    def __init__(self, pages):
        self.pages = pages

    def __call__(self, url, headers, timeout, most):
        body = self.pages.get(url)
        if isinstance(body, Exception):
            raise body
        if isinstance(body, str):
            return H.Response(301, {"Location": [body]})
        return H.Response(404) if body is None else H.Response(200, {"Content-Type": ["text/html" if body[:5] == b"<html" else "application/xml"]}, body[: most + 1])


E = "https://e.com"
SITE = {
    f"{E}/robots.txt": b"User-agent: *\nDisallow: /p\nSitemap: https://e.com/i.xml", f"{E}/i.xml": index(f"{E}/a.xml", f"{E}/n.xml", f"{E}/gone.xml", f"{E}/a.xml#again", f"{E}/i.xml", f"{E}/bad.xml", f"{E}/f.xml", f"{E}/moved.xml"),
    f"{E}/n.xml": index(f"{E}/b.xml", f"{E}/i.xml", f"{E}/z.xml.gz"), f"{E}/a.xml": urlset(f"{E}/p/1", f"{E}/2"), f"{E}/b.xml": urlset(f"{E}/3"), f"{E}/z.xml.gz": gzip.compress(urlset(f"{E}/4")), f"{E}/bad.xml": b"<urlset><x",
    f"{E}/f.xml": b"<feed xmlns='urn:odd'/>", f"{E}/moved.xml": f"{E}/a.xml", f"{E}/p/1": b"<html><head><meta name=robots content=noindex><link rel=canonical href=/p/1></head>", f"{E}/2": f"{E}/4", f"{E}/4": b"<html><head><link rel=canonical href=/4></head>",
}


def codes(df):
    return sorted({r.code for r in df.select("code").collect()})


@pytest.fixture(scope="module")
def audited(spark):
    return api.audit(spark, "e.com/i.xml", transport=Site(SITE))


def test_expansion(audited):
    tree = [(r.depth, r.sitemap_url[len(E) :], r.page_count, r.status, r.reason) for r in audited.tree.collect()]
    assert tree == [
        (0, "/i.xml", 8, "accepted", None), (1, "/a.xml", 2, "accepted", None), (1, "/n.xml", 3, "accepted", None), (2, "/b.xml", 1, "accepted", None), (2, "/i.xml", None, "rejected", "cycle"), (2, "/z.xml.gz", 1, "accepted", None),
        (1, "/gone.xml", None, "rejected", "http-404"), (1, "/i.xml", None, "rejected", "cycle"), (1, "/bad.xml", None, "rejected", "unparseable"), (1, "/f.xml", None, "rejected", "unsupported-feed"), (1, "/a.xml", 2, "accepted", None),
    ]
    assert [r.loc[len(E) :] for r in audited.urls.collect()] == ["/p/1", "/2", "/3", "/4", "/p/1", "/2"]
    assert codes(audited.findings) == ["INDEX_CYCLE_DETECTED", "SITEMAP_INDEX_NESTED", "UNSUPPORTED_FEED"]


def test_redirect_chain_and_timing(spark, audited):
    got = {r.requested_url[len(E) :]: r for r in audited.sources.collect()}
    assert got["/moved.xml"].redirect_chain == [f"{E}/moved.xml", f"{E}/a.xml"] and got["/a.xml"].redirect_chain == [f"{E}/a.xml"]
    assert all(r.timing >= 0 for r in got.values())
    mixed = api.load(spark, [f"{E}/a.xml", ("b.xml", urlset(f"{E}/1"))], transport=Site(SITE))
    rows = {r.requested_url: r for r in S.sources(S.parse(mixed)).collect()}
    assert rows["b.xml"].redirect_chain == [] and rows["b.xml"].timing is None and rows[f"{E}/a.xml"].timing >= 0


def test_replay_budgets():
    def run(**k):
        nodes = {f"u{i}": _Node(f"u{i}", "urlset", None, 200, 10, False) for i in range(5)}
        r = _Replay("d", "b", nodes, limits.IndexLimits(**k))
        r.node("root", [(f"u{i}", f"u{i}") for i in range(5)], 0)
        return [x[2] for x in r.leaves], [e[2] for e in r.events]

    assert run() == ([1, 2, 3, 4, 5], [])
    assert run(max_total_sitemaps=2) == ([1, 2], ["INDEX_TOTAL_SITEMAPS_EXCEEDED"])
    assert run(max_total_urls=25) == ([1, 2], ["INDEX_TOTAL_URLS_EXCEEDED"])
    assert run(max_children=3) == ([1, 2, 3], ["INDEX_CHILD_COUNT_EXCEEDED"])


def test_depth(spark):
    chain = {f"{E}/{i}.xml": index(f"{E}/{i + 1}.xml") for i in range(6)}
    out = api.audit(spark, f"{E}/0.xml", transport=Site(chain))
    assert [r.depth for r in out.tree.collect()] == [0, 1, 2, 3, 4] and "INDEX_DEPTH_EXCEEDED" in codes(out.findings)


def test_validate_with_pages_and_robots(spark):
    robots = spark.createDataFrame([(E, SITE[f"{E}/robots.txt"].decode())], "origin string, text string")
    v = api.validate(spark, f"{E}/a.xml", transport=Site(SITE), robots_files=robots, inspect=api.PageInspection(Site(SITE)), ruleset="google", context=Context())
    got = {r.code: r for r in v.findings.collect()}
    assert {"ROBOTS_DISALLOWED", "PAGE_META_ROBOTS_NOINDEX", "PAGE_STATUS_REDIRECT", "PAGE_CANONICAL_MISMATCH"} <= got.keys()
    assert "robots.txt" in got["PAGE_META_ROBOTS_NOINDEX"].remediation_hint and got["ROBOTS_DISALLOWED"].ruleset == "google"
    assert v.coverage.first().selected == 2 and v.coverage.first().completed == 2


def test_tree_and_probe(spark):
    t = Site(SITE)
    rows = api.tree(spark, "e.com", transport=t).collect()
    assert (rows[0].sitemap_url, rows[0].reason) == (f"{E}/i.xml", "robots") and sum(r.depth == 0 for r in rows) == 11 and sum(r.status == "accepted" for r in rows) == 6
    kinds = {u: api.probe(u, transport=t)["detected_type"] for u in (f"{E}/i.xml", f"{E}/a.xml", f"{E}/robots.txt", f"{E}/4", f"{E}/none", f"{E}/bad.xml")}
    assert list(kinds.values()) == ["sitemap_index", "sitemap", "robots_txt", "html", "not_found", "parse_error"]
    assert api.probe(f"{E}/4", transport=t)["content_type"] == "text/html" and api.probe(f"{E}/none", transport=t)["content_type"] is None
    assert api.tree_from_bytes(spark, urlset(f"{E}/1"), f"{E}/s.xml").first().page_count == 1


def test_diff_and_report(spark, audited, tmp_path):
    assert api.diff(audited, audited).unchanged()
    other = api.audit(spark, "e.com/i.xml", transport=Site(SITE | {f"{E}/b.xml": urlset(f"{E}/33")}))
    d = api.diff(audited, other)
    n = {(r.component, r.change): r.n for r in d.counts().collect()}
    assert (n["urls", "added"], n["urls", "removed"]) == (1, 1) and not d.unchanged()
    page = report.report(audited, str(tmp_path / "r.html"), "A <title>")
    assert "A &lt;title&gt;" in page and (tmp_path / "r.html").read_text() == page and "SITEMAP_INDEX_NESTED" in page


def test_inputs(spark, tmp_path):
    rows = api.source_records(spark, ["Example.com/s.xml", "https://example.com:443/s.xml#x", "http://a.com"]).collect()
    assert [(r.normalized_url, r.scheme_inferred, r.provenance) for r in rows] == [("https://example.com/s.xml", True, "submitted-list"), ("http://a.com/", False, "submitted-list")]
    for bad in ([], [""], ["ftp://a.com/"], [f"a{i}.com" for i in range(26)]):
        with pytest.raises(ValueError):
            api.source_records(spark, bad)
    with pytest.raises(ValueError):
        api.load(spark, "https://a.com/")
    f = tmp_path / "s.xml"
    f.write_bytes(urlset("http://a.com/x1"))
    assert [r.loc for r in api.read(spark, str(f)).urls.collect()] == ["http://a.com/x1"]
    with pytest.raises(api.SourceFailed):
        api.read(spark, ("x.xml", b"<broken"))
    out = api.read(spark, ("x.xml", b"<broken"), errors="capture")
    assert out.urls.count() == 0 and out.problems.count() == 1


def test_limits():
    for make in (lambda: limits.FetchLimits(timeout=0), lambda: limits.IndexLimits(max_depth=-1), lambda: limits.FetchLimits(timeout=float("nan")), lambda: limits.ArchiveLimits(max_file_count=float("inf")), lambda: H.Retry(max_tries=0), lambda: H.Throttle(requests=1), lambda: Context("no such"), lambda: Ruleset("none")):
        with pytest.raises(ValueError):
            make()
    assert limits.IndexLimits().max_total_urls == float("inf")


def test_fetching():
    t = Site({"http://a.com/": "http://a.com/2", "http://a.com/2": b"<html>", "http://b.com/": "http://127.0.0.1/", "http://c.com/": "http://c.com/", "https://d.com/": "http://d.com/x", "http://e.com/": H.TransportError("timeout"), "http://f.com/": b"x" * 100, "http://i.com/": b"ok"})
    go = lambda u, **k: H.fetch(u, t, **k)
    assert (go("http://a.com/").outcome, go("http://a.com/").final, len(go("http://a.com/").hops)) == ("usable_body", "http://a.com/2", 1)
    assert go("http://b.com/").outcome == "safety_refused" and go("http://c.com/").outcome == "redirect_over_budget" and go("https://d.com/", no_downgrade=True).outcome == "safety_refused"
    assert go("http://e.com/").outcome == "timeout" and go("http://none.com/").outcome == "http_status"
    assert (go("http://f.com/", cap=10).outcome, go("http://f.com/", cap=10).body) == ("partial", b"x" * 10) and go("http://f.com/", limits=limits.FetchLimits(max_bytes=10)).outcome == "body_ceiling"
    assert go("https://i.com/", scheme_inferred=True).outcome == "http_status"
    tries = []

    def flaky(url, headers, timeout, most):
        tries.append(headers.get("Authorization"))
        return H.Response(503, {"Retry-After": ["9999"]}) if len(tries) < 3 else H.Response(200, {}, b"ok")

    slept = []
    pacer = H.Pacer(H.Throttle(min_interval=2), clock=lambda: 0.0, sleep=slept.append)
    got = H.fetch("http://a.com/", flaky, H.Policy(auth=H.basic_auth("u", "p"), retry=H.Retry(max_tries=3, backoff_max=5)), pacer=pacer)
    assert got.outcome == "usable_body" and tries == ["Basic dTpw"] * 3 and slept == [5.0, 2.0, 5.0, 2.0]


def test_archives_and_rulesets(spark):
    def tar(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, body in members:
                i = tarfile.TarInfo(name)
                i.size = len(body)
                t.addfile(i, io.BytesIO(body))
        return out.getvalue()

    docs = [
        ("ok.tar.gz", tar([("a.xml", urlset("http://a.com/abc")), ("b.txt", b"http://a.com/t\nnope"), ("c.md", b"x"), ("../e.xml", urlset("http://a.com/evil")), ("i.xml", index("http://a.com/s.xml"))])),
        ("many.tar.gz", tar([(f"{i}.txt", b"http://a.com/") for i in range(101)])), ("cut.gz", gzip.compress(urlset("http://a.com/abc"))[:-12]), ("f.xml", b"<rss><channel><item><link>http://a.com/1</link><pubDate>Mon, 1 Jan</pubDate></item></channel></rss>"),
        ("t.txt", b"http://a.com/1\n\nrel\n"), ("h.xml", b"<html>"), ("u.xml", b"<opml/>"), ("ns.xml", b"<urlset xmlns='urn:x'><url><loc>http://a.com/abc</loc></url></urlset>"),
    ]
    parsed = Workspace(spark, "test").table(S.with_base(S.parse(S.from_bytes(spark, docs))), "parsed")

    def found(**k):
        out = {}
        for r in validate(parsed, ordered=False, **k).collect():
            out.setdefault(r.subject_ref[len("sitemap://") :].split("#")[0], set()).add(r.code)
        return out

    got = found()
    assert got["ok.tar.gz"] == {"PROTOCOL_URL_NOT_ABSOLUTE", "DECOMPRESS_NOT_SITEMAP"} and got["many.tar.gz"] == {"DECOMPRESS_TOO_MANY_FILES"} and got["cut.gz"] == {"UNSUPPORTED_MALFORMED_GZIP"}
    assert got["f.xml"] == {"PROTOCOL_LASTMOD_INVALID"} and got["t.txt"] == {"PROTOCOL_TEXT_BLANK_LINE", "PROTOCOL_URL_NOT_ABSOLUTE"} and got["h.xml"] == {"UNSUPPORTED_HTML_MASQUERADE"} and got["u.xml"] == {"UNSUPPORTED_ROOT"} and got["ns.xml"] == {"SCHEMA_UNKNOWN_NAMESPACE"}
    assert "PROTOCOL_TEXT_BLANK_LINE" not in found(mode="non-strict")["t.txt"]
    assert "ENGINE_UNSUPPORTED_SITEMAP_FORMAT" in found(ruleset=Ruleset("yandex"))["f.xml"] and "ENGINE_UNSUPPORTED_SITEMAP_FORMAT" not in found(ruleset=Ruleset("google", gsc_submission("http://a.com/")))["f.xml"]
    bad = validate(parsed, "non-strict", ordered=False).where("layer = 'schema'").collect()
    assert {r.severity for r in bad} == {"warning"}
    assert sorted(map(repr, validate(parsed.repartition(7), ordered=False).collect())) == sorted(map(repr, validate(parsed, ordered=False).collect()))


def test_robots_rules(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: Bot\nAllow: /a*b$\nDisallow: /a\n"
    rules = RB.rules(spark.createDataFrame([("http://x.com", text)], "origin string, text string"))
    locs = spark.createDataFrame([(u,) for u in ("http://x.com/a/1", "http://x.com/axxb", "http://x.com/z", "http://y.com/", "rel")], "loc string")
    states = spark.createDataFrame([("http://x.com", "ok"), ("http://y.com", "absent")], "origin string, state string")
    decide = lambda **k: {r.loc: r.decision for r in RB.decide(locs, rules, **k).collect()}
    assert decide(agent="bot", reachable=states) == {"http://x.com/a/1": "disallow", "http://x.com/axxb": "allow", "http://x.com/z": "allow", "http://y.com/": "allow"}
    assert decide()["http://x.com/z"] == "disallow" and decide(reachable=states.where("state = 'ok'"))["http://y.com/"] == "undetermined"


def test_robots_groups(spark):
    """An empty group is the agent's own; versions are cut from names; both sides are spelled alike; no rule is slow."""
    text = "User-agent: Googlebot/2.1\nDisallow:\n\nUser-agent: *\nDisallow: /ü\nDisallow: /%7ea\nDisallow: /x*y*z$\nDisallow: /" + "a*" * 40 + "$\n"
    rules = RB.rules(spark.createDataFrame([("http://x.com", text)], "origin string, text string"))
    paths = {"/ü/1": "disallow", "/%c3%bc": "disallow", "/~a": "disallow", "/xyz": "disallow", "/x1y2z": "disallow", "/xyz1": "allow", "/xz": "allow", "/" + "a" * 60 + "b": "disallow", "/free": "allow"}
    locs = spark.createDataFrame([("http://x.com" + p,) for p in paths], "loc string")
    assert {r.loc[12:]: r.decision for r in RB.decide(locs, rules).collect()} == paths
    assert {r.decision for r in RB.decide(locs, rules, agent="googlebot").collect()} == {"allow"}
    assert {r.decision for r in RB.decide(locs, rules, agent="Googlebot/9").collect()} == {"allow"} and RB.decide(locs, rules, agent="other").where("decision = 'disallow'").count() == 6
    for rule, path, want in (("/", "/a", 1), ("/a$", "/a", 1), ("/a$", "/ab", 0), ("*b", "/ab", 1), ("/a*", "/a", 1), ("/*a$", "/ba", 1), ("/a*a$", "/a", 0), ("$", "", 1), ("*", "/x", 1), ("/a*b*b$", "/ab", 0)):
        assert RB.rule_matches(rule, path) == bool(want), (rule, path)


def test_validate_fetches_robots(spark):
    v = api.validate(spark, f"{E}/a.xml", transport=Site(SITE), check_robots=True)
    assert "ROBOTS_DISALLOWED" in codes(v.findings)
    v = api.validate(spark, ("http://n.com/s.xml", urlset("http://n.com/1")), transport=Site({}), check_robots=True)
    assert not any(c.startswith("ROBOTS") for c in codes(v.findings))
    with pytest.raises(ValueError):
        api.validate(spark, ("http://n.com/s.xml", urlset("http://n.com/1")), check_robots=True)


@pytest.mark.parametrize(("budget", "cap", "attempted"), [({"max_requests": 1}, ["max_requests"], 1), ({"max_bytes": 1}, ["max_bytes"], 1), ({"max_seconds": 1e-9}, ["max_seconds"], 0), ({}, [], 2)])
def test_page_budget(spark, budget, cap, attempted):
    v = api.validate(spark, f"{E}/a.xml", transport=Site(SITE), inspect=api.PageInspection(Site(SITE), budget=PageBudget(**budget)))
    c = v.coverage.first()
    assert (c.caps_hit, c.partial_run, c.attempted, c.skipped, c.selected) == (cap, bool(cap), attempted, 2 - attempted, 2)
    assert c.eligible >= c.deduplicated >= c.selected and c.mode == "sample" and c.elapsed >= 0


def test_gzip_bomb():
    data = gzip.compress(b"\0" * 3_000_000)
    with pytest.raises(raw.SourceError, match="more than"):
        raw.gunzip(data, 1_000_000)
    assert len(raw.gunzip(data, 3_000_000)) == 3_000_000


def test_proxy_and_certificates():
    from sitequarry.sources import http

    p = http.Policy(proxy=http.Proxy("http://proxy.example", 8080, "u", "p:w"), verify_tls=False)
    handlers = {type(h).__name__: h for h in http._handlers(p) if not isinstance(h, type)}
    assert handlers["ProxyHandler"].proxies["https"] == "http://u:p%3Aw@proxy.example:8080" and handlers["HTTPSHandler"]._context.check_hostname is False
    assert len(http._handlers(http.Policy())) == 1


def test_children_in_capitals(spark):
    """A child is fetched however its scheme is spelled, and in the first spelling that the index has."""
    site = {"https://c.com/i.xml": index("HTTPS://c.com/a.xml", "https://c.com/a.xml#b"), "HTTPS://c.com/a.xml": urlset("https://c.com/1")}
    out = api.audit(spark, "https://c.com/i.xml", transport=Site(site))
    assert [r.loc for r in out.urls.collect()] == ["https://c.com/1"]


def test_stream(spark, tmp_path):
    drop = tmp_path / "in"
    drop.mkdir()
    (drop / "a.xml").write_bytes(urlset("http://a.com/abc", "http://a.com/abc"))
    watch(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (drop / "b.xml").write_bytes(b"<html>")
    watch(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.batch, r.code) for r in out.collect()} >= {(0, "PROTOCOL_DUPLICATE_LOC"), (1, "UNSUPPORTED_HTML_MASQUERADE")}


def test_on_urls(spark):
    seen = []
    api.audit(spark, f"{E}/n.xml", transport=Site(SITE), on_urls=lambda rows, source: seen.append((source[len(E) :], rows.count())))
    assert ("/b.xml", 1) in seen

    def fail(rows, source):
        raise KeyError(source)

    with pytest.raises(RuntimeError, match="b.xml"):
        api.audit(spark, f"{E}/n.xml", transport=Site(SITE), on_urls=fail)
