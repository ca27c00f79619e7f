"""Functions: URLs, dates, tokens, bytes."""

import gzip
import io
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.functions import ssrf
from sitequarry.functions import urls as U
from sitequarry.functions import values as V
from sitequarry.sources import raw, xmltree, xsd
from sitequarry.sources.documents import parse_bytes, split_lines

URLS = {
    "https://münchen.de/": "https://xn--mnchen-3ya.de/",
    "https://a.example/é?q=日": "https://a.example/%C3%A9?q=%E6%97%A5",
    "https://b.example/a%20b/x": "https://b.example/a%20b/x",
    "https://a.example/x/../maps//./m.xml": "https://a.example/maps/m.xml",
    "https://b.example:8443/p": "https://b.example:8443/p",
    "https://me:pw@a.example:99/p?z=2": "https://me@a.example:99/p?z=2",
    "http://b.example:80/s": "http://b.example/s",
    "https://b.example:443/s#f": "https://b.example/s",
    "http://b.example:443/s": "http://b.example:443/s",
    "HTTPS://B.Example": "https://b.example/",
    "https://b.example?page=2": "https://b.example/?page=2",
    "https:///nohost": "https:///nohost",
    "/relative": "/relative",
    "ftp://b.example/x": "ftp://b.example/x",
}


def test_keys(spark):
    df = U.with_url(spark.createDataFrame([(u,) for u in URLS], "loc string"))
    got = {r.loc: r.loc_key for r in df.collect()}
    assert got == URLS


@settings(max_examples=150, deadline=None)
@given(st.text("abz019./-_~?&=#:%@ü ", max_size=25))
def test_canonical_is_stable(rest):
    once = U.loc_key(f"https://host.example/{rest}")
    assert U.loc_key(once) == once


def test_fast_and_slow_paths_agree(spark):
    plain = [f"{s}://{h}{p}{path}{q}{f}" for s in ("http", "HTTPS") for h in ("a.com", "Sub.A-b.co.uk") for p in ("", *(f":{n}" for n in (80, 443, 8080))) for path in ("", "/", "/x/y.html", "/~u/a_b/") for q in ("", "?a=1&b=/?") for f in ("", "#", "#top")]
    rows = U.with_url(spark.createDataFrame([(u,) for u in plain], "loc string")).collect()
    for r in rows:
        assert (r.loc_key, *r.url[:7]) == (U.loc_key(r.loc), *U.canonical(r.loc)), r.loc


def test_lastmod(spark):
    cases = {
        "2024-02-29": ("date-only", 1709164800), "2023-02-29": ("invalid", None), " 2024-01-15T10:30:00Z ": ("datetime", 1705314600), "2024-01-15T10:30:00+0200": ("datetime", 1705307400), "2024-01-15T10:30:00.5-05:00": ("datetime", 1705332600),
        "2024-01-15T10:30:00": ("invalid", None), "2024-01-15T10:30Z": ("invalid", None), "2024": ("invalid", None), "2024-01": ("invalid", None), "": ("absent", None), None: ("absent", None), "Mon, 15 Jan 2024": ("invalid", None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "x string").select("x", V.lastmod_class(F.col("x")).alias("c"), F.unix_seconds(V.parse_lastmod(F.col("x"))).alias("t"))
    assert {r.x: (r.c, r.t) for r in df.collect()} == cases


def test_decoded_length(spark):
    rows = spark.createDataFrame([("a%41b",), ("a+b",), ("%zz",), ("%C3%BC",)], "x string").select(U.decoded_length(F.col("x")).alias("n")).collect()
    assert [r.n for r in rows] == [3, 3, 3, 1]


@pytest.mark.parametrize(
    "url,why",
    [
        ("http://127.0.0.1/", "blocked-ip"), ("http://10.1.2.3/", "blocked-ip"), ("http://169.254.169.254/", "blocked-ip"), ("http://2130706433/", "numeric-host"), ("http://0x7f.1/", "numeric-host"), ("http://0177.0.0.1/", "numeric-host"),
        ("http://[::1]/", "blocked-ip"), ("http://[::ffff:10.0.0.1]/", "blocked-ip"), ("http://[64:ff9b::a00:1]/", "blocked-ip"), ("http://[fe80::1]/", "blocked-ip"), ("http://metadata.google.internal/", "blocked-host"),
        ("http://localhost/", "blocked-host"), ("ftp://b.example/", "bad-scheme"), ("nonsense", "bad-url"), ("https://b.example/", None), ("http://93.184.216.34/", None), ("http://[2606:2800:220:1::1]/", None), ("http://100.64.0.1/", "blocked-ip"),
    ],
)
def test_ssrf(url, why):
    assert ssrf.check(url) == why


def samples():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        i = tarfile.TarInfo("a.txt")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    return {
        "empty": b"", "gzip": gzip.compress(b"x"), "tar": tar.getvalue(), "xml-urlset": b"\xef\xbb\xbf<?xml version='1.0'?>\n<!-- a --><!DOCTYPE x [<!ENTITY a 'b'>]><s:urlset>", "xml-sitemapindex": b"  <sitemapindex\n>",
        "feed": b"<rss version='2.0'>", "xml": b"<note/>", "html": b"<!-- c --><HTML lang=en>", "text": b"https://a.com/\n", "binary": b"\x00\x01\x02",
    }


def test_sniff(spark):
    docs = samples()
    assert {k: raw.sniff(v) for k, v in docs.items()} == {k: k for k in docs}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "k string, b binary")
    assert {r.k: r.f for r in df.select("k", raw.sniff_column(F.col("b")).alias("f")).collect()} == {k: k for k in docs}
    for page in (b"<!doctype html><p>", b"<p>x", b"<title>x"):
        assert raw.sniff(page) == "html"


def test_gzip_and_tar():
    assert raw.gunzip(gzip.compress(b"abc") + gzip.compress(b"d")) == b"abcd"
    for bad in (gzip.compress(b"abc" * 100)[:-9], b"\x1f\x8bnonsense"):
        with pytest.raises(raw.SourceError):
            raw.gunzip(bad)
    assert [(m.name, m.content) for m in raw.tar_members(samples()["tar"])] == [("a.txt", b"abc")]
    with pytest.raises(raw.SourceError):
        raw.tar_members(samples()["tar"][:514])
    assert [raw.unsafe_name(n) for n in ("", "/a", "a/../b", "C:\\x", "..", "a/b..c")] == [True, True, True, True, True, False]


NS = f'xmlns="{xmltree.CORE}"'


def issues(body, root="urlset", ns=NS):
    return [(i[1], i[2]) for i in xsd.issues(xmltree.parse(f"<{root} {ns}>{body}</{root}>".encode()).root)]


@pytest.mark.parametrize(
    "body,element",
    [
        ("<url><loc>http://a.com/xyz</loc></url>", None), ("", "urlset"), ("<url></url>", "url"), ("<url><loc>http://a</loc></url>", "loc"), ("<url><lastmod>2024-01-01</lastmod><loc>http://a.com/xyz</loc></url>", "lastmod"),
        ("<url><loc>http://a.com/xyz</loc><priority>1.1</priority></url>", "priority"), ("<url><loc>http://a.com/xyz</loc><changefreq>Daily</changefreq></url>", "changefreq"), ("<url><loc>http://a.com/xyz</loc><loc>http://a.com/xyz</loc></url>", "loc"),
        ("<url><loc>http://a.com/xyz</loc><x/></url>", "x"), ("<url><loc>http://a.com/xyz</loc>text</url>", "url"), ("<url><loc a='b'>http://a.com/xyz</loc></url>", "loc"),
        (f"<url><loc>http://a.com/xyz</loc><i:image xmlns:i='{xmltree.IMAGE}'/></url>", "image"),
        (f"<url><loc>http://a.com/xyz</loc><i:image xmlns:i='{xmltree.IMAGE}'><i:loc>http://a.com/i</i:loc></i:image></url>", None),
        (f"<url><loc>http://a.com/xyz</loc><x:link xmlns:x='{xmltree.XHTML}' rel='alternate'/></url>", "link"),
    ],
)
def test_schema(body, element):
    found = issues(body)
    assert [e for e, _ in found] == ([element] if element else [])


def test_entities_are_not_expanded():
    p = parse_bytes(f"<!DOCTYPE urlset [<!ENTITY x SYSTEM 'file:///etc/passwd'>]><urlset {NS}><url><loc>http://a.com/&x;</loc></url></urlset>".encode())
    assert p["entities"] and p["entries"][0]["loc"] == "http://a.com/"


def test_feeds():
    rss = parse_bytes(b"<rss><channel><item><link> https://a.com/1 </link><pubDate>Mon</pubDate></item><item/></channel></rss>")
    assert (rss["kind"], rss["variant"], [(e["loc"], e["lastmod"]) for e in rss["entries"]]) == ("feed", "rss2.0", [("https://a.com/1", "Mon")])
    atom = parse_bytes(b"<feed xmlns='http://www.w3.org/2005/Atom'><entry><link rel='self' href='https://a.com/s'/><link href='https://a.com/2'/><updated>2024-01-01T00:00:00Z</updated></entry></feed>")
    assert (atom["variant"], atom["entries"][0]["loc"], atom["entries"][0]["lastmod"]) == ("atom1.0", "https://a.com/2", "2024-01-01T00:00:00Z")
    assert parse_bytes(b"<feed xmlns='urn:x'/>")["error_class"] == "unsupported_feed"


def test_lines():
    assert split_lines("a\r\nb\rc\n\nd\n") == ["a", "b", "c", "", "d"] and split_lines("") == []
