"""Queries over the driver's tables, one or more for each operator, with the SQL that says the same.

The tables hold no sitemaps: each query derives its relation from ``pages``, ``documents``, ``orders`` or ``nation`` with expressions
that Spark and DuckDB share (``X_...``), then applies the operator. Whole tables always.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import limits as L
from ..functions import urls as U
from ..functions import values as V
from ..operators import diff as DF
from ..operators import document_rules as D
from ..operators import entry_rules as E
from ..operators import graph as G
from ..operators import index as I
from ..operators import pages as P
from ..operators import report as R
from ..operators import robots as RB
from ..operators.findings import assemble
from ..rulesets import Ruleset, gsc_submission
from ..sources import raw
from . import discovery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# == derived relations

X_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
X_LOC = f"""CASE page_id % 16 WHEN 0 THEN concat(url, '/a b') WHEN 1 THEN concat(url, '%zz') WHEN 2 THEN '/relative' WHEN 3 THEN concat('ftp://', {X_HOST}, '/f')
 WHEN 4 THEN replace(url, '://', '://user@') WHEN 5 THEN concat(url, 'ü') WHEN 6 THEN 'https:///nohost' ELSE url END"""
X_LASTMOD = """CASE page_id % 7 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '2024-01-15T10:30:00Z' WHEN 2 THEN '2024-13-01' WHEN 3 THEN 'yesterday' WHEN 4 THEN NULL
 WHEN 5 THEN ' 2023-06-30T23:59:59+02:00 ' ELSE '2024-01-15T10:30:00' END"""
X_FREQ = "CASE page_id % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'Daily' WHEN 2 THEN 'never' WHEN 3 THEN NULL ELSE 'often' END"
X_PRIORITY = "CASE page_id % 6 WHEN 0 THEN '0.5' WHEN 1 THEN '1.5' WHEN 2 THEN '-0.1' WHEN 3 THEN 'high' WHEN 4 THEN NULL ELSE '1.0' END"
_ENTRIES = (
    f"WITH e AS (SELECT page_id, url, {X_HOST} AS host, {X_LOC} AS loc, {X_LASTMOD} AS lastmod, {X_FREQ} AS changefreq, {X_PRIORITY} AS priority, "
    f"row_number() OVER (PARTITION BY {X_HOST} ORDER BY page_id) AS ix FROM pages), "
    "f AS (SELECT *, concat('sitemap://', host, '/en/sitemap.xml') AS base, concat('sitemap://', host, '/en/sitemap.xml#entry:', CAST(ix AS VARCHAR)) AS ref, "
    "page_id % 16 NOT IN (2, 3, 6) AS live FROM e) "
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", "url").withColumn("host", F.expr(X_HOST))


def _entries(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """Entries of a sitemap for each host, with the extensions given."""
    ix = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    rows = _pages(spark, d).withColumn("entry_ix", ix)
    exprs = {"loc": X_LOC, "lastmod": X_LASTMOD, "changefreq": X_FREQ, "priority": X_PRIORITY} | columns
    for k, v in exprs.items():
        rows = rows.withColumn(k, F.expr(v))
    for k in ("images", "video", "news", "alternates"):
        if k not in columns:
            rows = rows.withColumn(k, F.array())
    url = F.concat(F.lit("https://"), "host", F.lit("/en/sitemap.xml"))
    return rows.select(F.col("host").alias("doc_id"), U.base_ref(url).alias("base"), url.alias("sitemap_url"), "entry_ix", *exprs, *[k for k in ("images", "video", "news", "alternates") if k not in exprs], url.alias("source_sitemap"), "page_id")


def _found(found: DataFrame, *codes: str) -> DataFrame:
    return (found.where(F.col("code").isin(*codes)) if codes else found).select("code", "severity", "subject_ref")


def _rule(code: str, severity: str, where: str, ref: str = "ref") -> str:
    return f"SELECT '{code}' AS code, '{severity}' AS severity, {ref} AS subject_ref FROM f WHERE {where}"


# == URLs

X_PORTED = f"CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, {X_HOST}, concat({X_HOST}, ':8080')) WHEN 2 THEN replace(url, {X_HOST}, concat(upper({X_HOST}), ':443')) ELSE url END"
_SPLIT = f"""WITH p AS (SELECT page_id, {X_PORTED} AS loc FROM pages), s AS (SELECT page_id, loc, lower(regexp_extract(loc, '^([A-Za-z]+)://', 1)) AS scheme,
 lower(regexp_extract(loc, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, CAST(nullif(regexp_extract(loc, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1), '') AS INTEGER) AS port,
 coalesce(nullif(regexp_extract(loc, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, nullif(regexp_extract(loc, '[?]([^#]*)', 1), '') AS query,
 nullif(regexp_extract(loc, '#(.*)$', 1), '') AS fragment FROM p) """
_KEY = "concat(scheme, '://', host, CASE WHEN port IS NULL OR (scheme = 'http' AND port = 80) OR (scheme = 'https' AND port = 443) THEN '' ELSE concat(':', CAST(port AS VARCHAR)) END, path, CASE WHEN query IS NULL THEN '' ELSE concat('?', query) END)"


@query("url_split", _SPLIT + "SELECT page_id, scheme, host, coalesce(port, 0) AS port, path, query, fragment FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = _split(spark, d)
    return u.select("page_id", F.coalesce("u.port", F.lit(0)).alias("port"), *[F.col(f"u.{c}").alias(c) for c in ("scheme", "host", "path", "query", "fragment")])


def _split(spark: SparkSession, d: str) -> DataFrame:
    return U.with_url(_pages(spark, d).select("page_id", F.expr(X_PORTED).alias("loc")), "loc", "u")


@query("loc_key", _SPLIT + f"SELECT page_id, {_KEY} AS loc_key FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("page_id", "loc_key")


@query("absoluteness", f"SELECT page_id, CASE WHEN {X_LOC} LIKE 'http%://%' THEN 'http(s)' WHEN {X_LOC} LIKE 'ftp:%' THEN 'other-scheme' ELSE 'relative' END AS kind FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", U.absoluteness(F.expr(X_LOC)).alias("kind"))


for _name, _code, _severity, _where in (
    ("not_absolute", "PROTOCOL_URL_NOT_ABSOLUTE", "error", "page_id % 16 IN (2, 3)"),
    ("no_host", "PROTOCOL_URL_NO_HOST", "error", "page_id % 16 = 6"),
    ("invalid_escape", "PROTOCOL_URL_INVALID_ESCAPE", "error", "live AND len(regexp_extract_all(loc, '%')) <> len(regexp_extract_all(loc, '%[0-9A-Fa-f][0-9A-Fa-f]'))"),
    ("fragment", "PROTOCOL_URL_FRAGMENT", "info", "live AND contains(loc, '#')"),
    ("userinfo", "PROTOCOL_URL_USERINFO", "info", "page_id % 16 = 4"),
    ("scope", "PROTOCOL_URL_OUT_OF_SCOPE", "warning", "live AND NOT (url LIKE 'https://%' AND regexp_matches(url, '^[a-z]+://[^/]*/en/'))"),
):
    QUERIES[_name] = lambda spark, d, code=_code: _found(E.loc_findings(E.keyed(_entries(spark, d))), code)
    SQL[_name] = _ENTRIES + _rule(_code, _severity, _where)


@query("not_escaped", _ENTRIES + _rule("PROTOCOL_URL_NOT_ESCAPED", "warning", "live AND contains(loc, ' ')") + " UNION ALL " + _rule("PROTOCOL_URL_NOT_ESCAPED", "info", "page_id % 16 = 5"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.loc_findings(E.keyed(_entries(spark, d))), "PROTOCOL_URL_NOT_ESCAPED")


X_LONG = "concat(url, repeat('x', CAST(page_id % 4 AS INT) * 700))"


@query("url_too_long", _ENTRIES.replace(X_LOC, X_LONG) + _rule("PROTOCOL_URL_TOO_LONG", "warning", "length(loc) >= 2048"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.loc_findings(E.keyed(_entries(spark, d, loc=X_LONG))), "PROTOCOL_URL_TOO_LONG")


@query("tag_limits", _ENTRIES.replace(X_LOC, X_LONG) + _rule("PROTOCOL_TAG_DATA_LIMIT_EXCEEDED", "warning", "length(loc) >= 1500"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.field_findings(_entries(spark, d, loc=X_LONG), Ruleset("yandex")), "PROTOCOL_TAG_DATA_LIMIT_EXCEEDED")


X_CODED = "concat(url, repeat('%41', CAST(page_id % 5 AS INT) * 300))"


@query("decoded_length", _ENTRIES.replace(X_LOC, X_CODED) + _rule("PROTOCOL_URL_DECODED_TOO_LONG", "error", "length(replace(loc, '%41', 'A')) > 1024"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.loc_findings(E.keyed(_entries(spark, d, loc=X_CODED)), Ruleset("yandex")), "PROTOCOL_URL_DECODED_TOO_LONG")


# == duplicates

X_DUP = f"CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '#.*$', '') WHEN 1 THEN concat('https://', {X_HOST}, ':443/en/1') WHEN 2 THEN concat('https://', {X_HOST}, '/en/1') ELSE regexp_replace(url, '[?].*$', '') END"
_DUP = f"""WITH p AS (SELECT page_id, {X_HOST} AS doc, {X_DUP} AS loc, row_number() OVER (PARTITION BY {X_HOST} ORDER BY page_id) AS ix FROM pages),
 k AS (SELECT *, concat('sitemap://', doc, '/en/sitemap.xml#entry:', CAST(ix AS VARCHAR)) AS ref, regexp_replace(replace(loc, ':443/', '/'), '#.*$', '') AS key FROM p),
 f AS (SELECT *, min(ix) OVER (PARTITION BY doc, loc) AS first_raw, min(ix) OVER (PARTITION BY doc, key) AS first_key FROM k) """


@query("dup_loc", _DUP + _rule("PROTOCOL_DUPLICATE_LOC", "warning", "ix > first_raw"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.duplicate_findings(E.keyed(_entries(spark, d, loc=X_DUP))), "PROTOCOL_DUPLICATE_LOC")


@query("equiv_loc", _DUP + _rule("PROTOCOL_URL_EQUIVALENT", "warning", "ix = first_raw AND ix > first_key"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.duplicate_findings(E.keyed(_entries(spark, d, loc=X_DUP))), "PROTOCOL_URL_EQUIVALENT")


# == fields


@query(
    "field_values",
    _ENTRIES
    + " UNION ALL ".join(
        [
            _rule("PROTOCOL_PRIORITY_OUT_OF_RANGE", "error", "page_id % 6 IN (1, 2)"),
            _rule("PROTOCOL_CHANGEFREQ_INVALID", "error", "changefreq NOT IN ('always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never')"),
            _rule("PROTOCOL_LASTMOD_INVALID", "error", "page_id % 7 IN (2, 3, 6)"),
            _rule("PROTOCOL_LASTMOD_DATE_ONLY", "info", "page_id % 7 = 0"),
        ]
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.field_findings(_entries(spark, d)))


@query("lastmod_class", "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'date-only' WHEN 1 THEN 'datetime' WHEN 4 THEN 'absent' WHEN 5 THEN 'datetime' ELSE 'invalid' END AS class FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", V.lastmod_class(F.expr(X_LASTMOD)).alias("class"))


_INSTANT = "CASE page_id % 7 WHEN 0 THEN TIMESTAMP '2024-01-15 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-15 10:30:00' WHEN 5 THEN TIMESTAMP '2023-06-30 21:59:59' END"


@query("typed_rows", f"SELECT page_id, coalesce(CAST(epoch({_INSTANT}) AS BIGINT), 0) AS lastmod_epoch, CASE page_id % 6 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN (-0.1)::DOUBLE WHEN 5 THEN 1.0::DOUBLE END AS priority FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.coalesce(F.unix_seconds(V.parse_lastmod(F.expr(X_LASTMOD))), F.lit(0)).alias("lastmod_epoch"), V.parse_priority(F.expr(X_PRIORITY)).alias("priority"))


_DATED = f"WITH e AS (SELECT {X_HOST} AS host, {_INSTANT} AS t FROM pages), n AS (SELECT host, t, count(*) AS c FROM e WHERE t IS NOT NULL GROUP BY host, t), f AS (SELECT host, concat('sitemap://', host, '/en/sitemap.xml') AS ref, max(c) AS most, sum(c) AS n FROM n GROUP BY host) "


@query("lastmod_identical", _DATED + _rule("PROTOCOL_LASTMOD_ALL_IDENTICAL", "warning", "n >= 2 AND most / n >= 0.5"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(D.identical_lastmod(_entries(spark, d), L.ProtocolLimits(lastmod_identical_ratio=0.5)))


@query(
    "lastmod_generated",
    f"WITH e AS (SELECT {X_HOST} AS host, {_INSTANT} AS t FROM pages), f AS (SELECT concat('sitemap://', host, '/en/sitemap.xml') AS ref, count(*) AS n, "
    "avg(CASE WHEN abs(epoch(t) - epoch(TIMESTAMP '2024-01-15 12:00:00')) <= 86400 THEN 1.0 ELSE 0.0 END) AS share FROM e WHERE t IS NOT NULL GROUP BY host) "
    + _rule("PROTOCOL_LASTMOD_LOOKS_GENERATED", "info", "n >= 2 AND share >= 0.6"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    fetched = e.select("doc_id").distinct().withColumn("fetched_at", F.expr("timestamp '2024-01-15 12:00:00Z'"))
    return _found(D.generated_lastmod(e, fetched, L.ProtocolLimits(lastmod_identical_ratio=0.6)))


@query("url_count", f"WITH f AS (SELECT concat('sitemap://', {X_HOST}, '/en/sitemap.xml') AS ref, count(*) AS n FROM pages GROUP BY 1) " + _rule("PROTOCOL_URL_COUNT_EXCEEDED", "error", "n > 4"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(D.document_findings(_entries(spark, d), None, L.ProtocolLimits(max_url_count=4)), "PROTOCOL_URL_COUNT_EXCEEDED")


@query("doc_size", f"WITH f AS (SELECT concat('sitemap://', {X_HOST}, '/en/sitemap.xml') AS ref, sum(length(html)) AS n FROM pages GROUP BY 1) " + _rule("PROTOCOL_SIZE_EXCEEDED", "error", "n > 20000"))
def _(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "pages").groupBy(F.expr(X_HOST).alias("doc_id")).agg(F.sum(F.length("html")).alias("byte_size")).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    return _found(D.document_findings(_entries(spark, d), sizes, L.ProtocolLimits(max_uncompressed_bytes=20000)), "PROTOCOL_SIZE_EXCEEDED")


# == extensions

X_IMAGES = "transform(sequence(0, cast(page_id % 5 as int)), i -> named_struct('loc', url, 'caption', cast(null as string), 'geo_location', cast(null as string), 'title', cast(null as string), 'license', cast(null as string)))"
X_NEWS = "array(named_struct('publication', named_struct('name', 'n', 'language', case when page_id % 3 = 0 then 'english' when page_id % 3 = 1 then 'zh-cn' else 'en' end), 'access', cast(null as string), 'genres', cast(null as string), 'publication_date', case when page_id % 4 = 0 then '2024' else '2024-02-29' end, 'title', 't', 'keywords', cast(null as string), 'stock_tickers', cast(null as string)))"
_TEXT = "cast(null as string)"
X_VIDEO = (
    "array(named_struct(" + ", ".join(
        f"'{n}', {v}" for n, v in {
            "thumbnail_loc": "url", "title": "'t'", "description": "repeat('d', case when page_id % 11 = 0 then 2049 else 10 end)", "content_loc": _TEXT, "player_loc": _TEXT, "player_allow_embed": _TEXT,
            "player_autoplay": _TEXT, "duration": "case page_id % 4 when 0 then '0' when 1 then '120' when 2 then '1.5' else null end", "expiration_date": _TEXT,
            "rating": "case page_id % 3 when 0 then '5.5' when 1 then '4' else 'good' end", "view_count": _TEXT, "publication_date": _TEXT,
            "tags": "transform(sequence(1, case when page_id % 7 = 0 then 33 else 2 end), i -> 'tag')", "category": _TEXT, "family_friendly": "case page_id % 5 when 0 then 'Yes' when 1 then 'no' else null end",
            "restriction": "'DE'", "has_restriction": "page_id % 2 = 0", "restriction_relationship": "case page_id % 6 when 0 then 'allow' when 2 then 'only' else null end", "gallery_loc": _TEXT,
            "requires_subscription": _TEXT, "uploader": _TEXT, "uploader_info": _TEXT, "has_platform": "false", "platform": _TEXT, "platform_relationship": _TEXT, "live": "'yes'",
        }.items()
    ) + "))"
)


@query("images_count", _ENTRIES + _rule("PROTOCOL_IMAGE_COUNT_EXCEEDED", "error", "page_id % 5 + 1 > 3"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.extension_findings(_entries(spark, d, images=X_IMAGES, news=X_NEWS, video=X_VIDEO), L.ProtocolLimits(max_images_per_url=3)), "PROTOCOL_IMAGE_COUNT_EXCEEDED")


@query("news_count", f"WITH f AS (SELECT concat('sitemap://', {X_HOST}, '/en/sitemap.xml') AS ref, count(*) AS n FROM pages GROUP BY 1) " + _rule("PROTOCOL_NEWS_COUNT_EXCEEDED", "error", "n > 3"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(D.document_findings(_entries(spark, d, news=X_NEWS), None, L.ProtocolLimits(max_news_per_file=3)), "PROTOCOL_NEWS_COUNT_EXCEEDED")


@query("news_fields", _ENTRIES + _rule("PROTOCOL_NEWS_FIELD_INVALID", "error", "page_id % 3 = 0") + " UNION ALL " + _rule("PROTOCOL_NEWS_FIELD_INVALID", "error", "page_id % 4 = 0"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.extension_findings(_entries(spark, d, images=X_IMAGES, news=X_NEWS, video=X_VIDEO)), "PROTOCOL_NEWS_FIELD_INVALID")


@query(
    "video_fields",
    _ENTRIES + " UNION ALL ".join(_rule("PROTOCOL_VIDEO_FIELD_INVALID", "error", w, "concat(ref, ':video:1')") for w in ("page_id % 4 IN (0, 2)", "page_id % 3 IN (0, 2)", "page_id % 7 = 0", "page_id % 11 = 0", "page_id % 5 = 0", "page_id % 6 IN (2, 4)")),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.extension_findings(_entries(spark, d, images=X_IMAGES, news=X_NEWS, video=X_VIDEO)), "PROTOCOL_VIDEO_FIELD_INVALID")


# == alternates

_TOKENS = {
    "en": None, "EN": "HREFLANG_FORMAT_INVALID", "En": "HREFLANG_NONSTANDARD_CASE", "en-US": None, "en-us": "HREFLANG_NONSTANDARD_CASE", "en_US": "HREFLANG_SEPARATOR_INVALID", "": "HREFLANG_FORMAT_INVALID",
    " en": "HREFLANG_FORMAT_INVALID", "en--US": "HREFLANG_SEPARATOR_INVALID", "-en": "HREFLANG_SEPARATOR_INVALID", "en US": "HREFLANG_SEPARATOR_INVALID", "zh-Hant": None, "zh-hant": "HREFLANG_NONSTANDARD_CASE",
    "zh-Hant-TW": None, "zh-TW-Hant": "HREFLANG_FORMAT_INVALID", "english": "HREFLANG_FORMAT_INVALID", "x-default": None, "X-Default": "HREFLANG_XDEFAULT_INVALID", "x_default": "HREFLANG_XDEFAULT_INVALID", "en-419": "HREFLANG_FORMAT_INVALID",
}


@query(
    "hreflang_tokens",
    "WITH t(token, code) AS (VALUES " + ", ".join(f"('{t}', {repr(c) if c else 'NULL'})" for t, c in _TOKENS.items()) + ") SELECT n_nationkey, token, code FROM nation, t",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.explode(F.array(*map(F.lit, _TOKENS))).alias("token")
    return _table(spark, d, "nation").select("n_nationkey", tokens).select("n_nationkey", "token", V.hreflang_code(F.col("token")).alias("code"))


X_ALTS = (
    "array(named_struct('rel', case when page_id % 9 = 0 then 'canonical' else 'alternate' end, 'hreflang', 'en', 'href', url, 'media', cast(null as string)), "
    "named_struct('rel', 'alternate', 'hreflang', case page_id % 4 when 0 then 'EN' when 1 then 'x-default' when 2 then null else 'de' end, 'href', case when page_id % 5 = 0 then '/rel' else url end, 'media', cast(null as string)), "
    "named_struct('rel', 'alternate', 'hreflang', case page_id % 6 when 0 then 'x-default' when 1 then 'x-default' else 'fr' end, 'href', case when page_id % 7 = 0 then ' ' else url end, 'media', cast(null as string)))"
)
_LINK = "concat(ref, ':link:{}')"


@query("hreflang_dup", _ENTRIES + _rule("HREFLANG_DUPLICATE", "warning", "page_id % 4 = 0", _LINK.format(2)))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.hreflang_findings(E.links(_entries(spark, d, alternates=X_ALTS))), "HREFLANG_DUPLICATE")


@query("xdefault", _ENTRIES + _rule("HREFLANG_XDEFAULT_INVALID", "error", "page_id % 4 = 1 AND page_id % 6 IN (0, 1)", _LINK.format(3)) + " UNION ALL " + _rule("HREFLANG_XDEFAULT_MISSING", "info", "page_id % 4 <> 1 AND page_id % 6 NOT IN (0, 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.hreflang_findings(E.links(_entries(spark, d, alternates=X_ALTS))), "HREFLANG_XDEFAULT_INVALID", "HREFLANG_XDEFAULT_MISSING")


@query(
    "link_attrs",
    _ENTRIES + " UNION ALL ".join(_rule("HREFLANG_LINK_ATTR_INVALID", "error", w, _LINK.format(i)) for i, w in ((1, "page_id % 9 = 0"), (2, "page_id % 4 = 2"), (3, "page_id % 7 = 0"))),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.hreflang_findings(E.links(_entries(spark, d, alternates=X_ALTS))), "HREFLANG_LINK_ATTR_INVALID")


@query("href_relative", _ENTRIES + _rule("HREFLANG_HREF_RELATIVE", "warning", "page_id % 5 = 0", _LINK.format(2)))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(E.hreflang_findings(E.links(_entries(spark, d, alternates=X_ALTS))), "HREFLANG_HREF_RELATIVE")


# Graph: pages of one stretch of 50 are a document; each links to itself (not every third) and the next two (some left out).
X_CLEAN = "regexp_replace(url, '#.*$', '')"
X_LANG = "regexp_extract(url, '^[a-z]+://[^/]*/([a-z]*)', 1)"
_EDGES = f"""WITH p AS (SELECT page_id, page_id // 50 AS g, {X_CLEAN} AS url, {X_LANG} AS lang FROM pages),
 l AS (SELECT a.g, a.page_id AS s_id, a.url AS s, b.url AS t, CASE WHEN b.page_id % 11 = 0 AND a.page_id % 2 = 0 THEN 'xx' ELSE b.lang END AS lang
  FROM p a JOIN p b ON a.g = b.g AND b.page_id BETWEEN a.page_id - 1 AND a.page_id + 2 AND (b.page_id <> a.page_id OR a.page_id % 3 <> 0) AND NOT (b.page_id = a.page_id - 1 AND a.page_id % 4 = 0) AND NOT (a.page_id % 10 = 9 AND b.page_id > a.page_id) AND NOT (a.page_id % 10 IN (0, 1) AND b.page_id < a.page_id) AND NOT (a.page_id % 10 = 8 AND b.page_id = a.page_id + 2)) """


def _links(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages").select("page_id", F.expr("page_id div 50").alias("g"), F.expr(X_CLEAN).alias("u"), F.expr(X_LANG).alias("lang"))
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1, 2)))).alias("step")
    left = p.select("g", F.col("page_id").alias("a"), F.col("u").alias("loc"), step).withColumn("b", F.col("a") + F.col("step"))
    right = p.select("g", F.col("page_id").alias("b"), F.col("u").alias("href"), "lang")
    a, s = F.col("a"), F.col("step")
    keep = ~((s == 0) & (a % 3 == 0)) & ~((s == -1) & (a % 4 == 0)) & ~((a % 10 == 9) & (s > 0)) & ~((a % 10).isin(0, 1) & (s < 0)) & ~((a % 10 == 8) & (s == 2))
    rows = left.join(right, ["g", "b"]).where(keep)
    lang = F.when((F.col("b") % 11 == 0) & (a % 2 == 0), "xx").otherwise(F.col("lang"))
    doc = F.concat(F.lit("g"), F.col("g").cast("string"))
    return rows.select(doc.alias("doc_id"), F.concat(F.lit("sitemap://"), doc).alias("base"), a.cast("int").alias("entry_ix"), "loc", (s + 2).alias("link_ix"), F.lit("alternate").alias("rel"), lang.alias("hreflang"), "href")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """What the documents list: the first 45 of each 50 pages."""
    rows = _table(spark, d, "pages").where("page_id % 50 < 45").select(F.concat(F.lit("g"), F.expr("page_id div 50").cast("string")).alias("doc_id"), F.expr(X_CLEAN).alias("loc"))
    return U.with_url(rows).select("doc_id", "loc_key")


@query("hreflang_edges", _EDGES + "SELECT concat('g', CAST(g AS VARCHAR)) AS doc_id, s AS source_key, t AS target_key, lang AS hreflang, CAST(count(*) AS INTEGER) AS n_occurrences FROM l GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.alternate_edges(G.alternate_occurrences(_links(spark, d))).drop("base", "occurrences")


def _graph_findings(spark: SparkSession, d: str, code: str) -> DataFrame:
    edges = G.alternate_edges(G.alternate_occurrences(_links(spark, d)))
    return G.graph_findings(edges, _corpus(spark, d)).where(F.col("code") == code).select("code", "severity", "subject_ref", F.col("evidence.excerpt").alias("excerpt"))


_GREF = "concat('sitemap://g', CAST(g AS VARCHAR)) AS subject_ref"


@query("missing_self", _EDGES + f"SELECT DISTINCT 'HREFLANG_MISSING_SELF_REFERENCE' AS code, 'warning' AS severity, {_GREF}, s AS excerpt FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.g = l.g AND x.s = l.s AND x.t = l.s)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _graph_findings(spark, d, "HREFLANG_MISSING_SELF_REFERENCE")


@query(
    "non_reciprocal",
    _EDGES + f"SELECT DISTINCT 'HREFLANG_NON_RECIPROCAL' AS code, 'warning' AS severity, {_GREF}, concat(s, ' -> ', t) AS excerpt FROM l WHERE s <> t AND EXISTS (SELECT 1 FROM p c WHERE c.g = l.g AND c.url = l.t AND c.page_id % 50 < 45) "
    "AND NOT EXISTS (SELECT 1 FROM l x WHERE x.g = l.g AND x.s = l.t AND x.t = l.s)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _graph_findings(spark, d, "HREFLANG_NON_RECIPROCAL")


@query("inconsistent_lang", _EDGES + f"SELECT 'HREFLANG_INCONSISTENT_LANGUAGE' AS code, 'warning' AS severity, {_GREF}, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS excerpt FROM l GROUP BY g, t HAVING count(DISTINCT lang) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _graph_findings(spark, d, "HREFLANG_INCONSISTENT_LANGUAGE")


_COMPONENTS = (
    _EDGES.replace("WITH p", "WITH RECURSIVE p")
    + """, n AS (SELECT g, s AS v FROM l UNION SELECT g, t FROM l), b AS (SELECT g, s AS a, t AS b FROM l UNION SELECT g, t, s FROM l),
 r AS (SELECT g, v, v AS w FROM n UNION SELECT r.g, r.v, b.b FROM r JOIN b ON b.g = r.g AND b.a = r.w), c AS (SELECT g, v, min(w) AS root FROM r GROUP BY g, v),
 z AS (SELECT concat('g', CAST(g AS VARCHAR)) AS doc_id, v AS url_key, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.g = c.g AND p.url = c.v AND p.page_id % 50 < 45) THEN 'internal' ELSE 'external' END AS node_kind,
  CAST(dense_rank() OVER (PARTITION BY g ORDER BY root) AS INTEGER) AS cluster FROM c) """
)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    occ = G.alternate_occurrences(_links(spark, d))
    return G.alternate_clusters(G.alternate_nodes(occ, _corpus(spark, d)), G.alternate_edges(occ))


@query("components", _COMPONENTS + "SELECT doc_id, url_key, node_kind, cluster FROM z")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("doc_id", "url_key", "node_kind", "cluster")


@query(
    "cluster_summary",
    _COMPONENTS + "SELECT doc_id, cluster, CAST(count(*) AS INTEGER) AS size, CAST(count(*) FILTER (node_kind = 'internal') AS INTEGER) AS n_internal, CAST(count(*) FILTER (node_kind = 'external') AS INTEGER) AS n_external, string_agg(url_key, ' ' ORDER BY url_key) AS members FROM z GROUP BY ALL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.cluster_summary(_clusters(spark, d)).withColumn("members", F.array_join("members", " "))


# == pages

X_OUTCOME = "CASE page_id % 8 WHEN 0 THEN 'transport_fail' WHEN 1 THEN 'http_status' WHEN 2 THEN 'redirect_over_budget' WHEN 3 THEN 'safety_refused' WHEN 4 THEN 'incomplete' ELSE 'usable_body' END"
X_FINAL = "CASE WHEN page_id % 3 = 0 THEN concat(url, 'x') ELSE url END"
_PAGE = f"WITH f AS (SELECT page_id, concat('sitemap://', {X_HOST}, '/s.xml#page-url:', url) AS ref, {X_OUTCOME} AS outcome, url NOT LIKE '%#%' AND page_id % 3 = 0 AS moved FROM pages) "


def _artifacts(spark: SparkSession, d: str, body: str = "''", headers: str = "map('Content-Type', array('text/html'))") -> DataFrame:
    return _table(spark, d, "pages").select(
        F.col("url").alias("loc"), F.col("url").alias("requested_url"), F.expr(X_FINAL).alias("final_url"), F.expr("case when page_id % 8 = 1 then 404 else 200 end").alias("status"),
        F.expr("cast(array() as array<struct<url:string,status:int,location:string>>)").alias("hops"), F.expr(headers).alias("headers"), F.encode(F.expr(body), "UTF-8").alias("body"), F.lit(False).alias("truncated"),
        F.expr(X_OUTCOME).alias("outcome"), F.concat(F.lit("sitemap://"), F.expr(X_HOST), F.lit("/s.xml")).alias("base"), "page_id",
    )


@query(
    "page_status",
    _PAGE
    + " UNION ALL ".join(
        [
            _rule("PAGE_FETCH_FAILED", "error", "outcome IN ('transport_fail', 'incomplete')"), _rule("PAGE_STATUS_ERROR", "error", "outcome = 'http_status'"), _rule("PAGE_REDIRECT_CHAIN", "info", "outcome = 'redirect_over_budget'"),
            _rule("PAGE_SSRF_BLOCKED", "error", "outcome = 'safety_refused'"), _rule("PAGE_STATUS_REDIRECT", "warning", "outcome = 'usable_body' AND moved"),
        ]
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(P.transport_findings(_artifacts(spark, d)))


X_BODY = f"CASE page_id % 5 WHEN 0 THEN '<html><head></head></html>' WHEN 1 THEN concat('<head><link href=\"', {X_CLEAN}, '\" rel=canonical>') WHEN 2 THEN '<head><link rel=canonical href=/other>' ELSE concat('<head><base href=\"', {X_CLEAN}, '\"><link href=\"\" rel=\"canonical\"><link rel=\"canonical\" href=\"', url, '\">') END"


@query("canonical_mismatch", _PAGE + _rule("PAGE_CANONICAL_MISSING", "info", "outcome = 'usable_body' AND page_id % 5 = 0") + " UNION ALL " + _rule("PAGE_CANONICAL_MISMATCH", "warning", "outcome = 'usable_body' AND page_id % 5 = 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(P.canonical_findings(P.facts(_artifacts(spark, d, X_BODY))))


X_META = "CASE page_id % 4 WHEN 0 THEN '<meta name=\"robots\" content=\"noindex, follow\">' WHEN 1 THEN '<meta name=\"yandex\" content=\"all\">' ELSE '' END"
X_HEADERS = "map('X-Robots-Tag', array(CASE page_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'yandexbot: noindex' WHEN 2 THEN 'index' ELSE 'nofollow' END))"
_FOLD = "page_id % 4 = 0 AS meta_no, page_id % 6 IN (0, 1) AS header_no, page_id % 4 = 1 OR page_id % 6 = 2 AS explicit_index"


@query(
    "noindex_fold",
    f"WITH f AS (SELECT page_id, {_FOLD} FROM pages) SELECT page_id, meta_no, header_no, explicit_index, CASE WHEN NOT (meta_no OR header_no) THEN 'none' WHEN explicit_index THEN 'conflict' WHEN meta_no AND header_no THEN 'cross_channel' ELSE 'single_channel' END AS path, (meta_no OR header_no) AND NOT explicit_index AS effective FROM f",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.noindex_fold(P.facts(_artifacts(spark, d, X_META, X_HEADERS)), "yandex").select("page_id", "meta_no", "header_no", "explicit_index", "path", "effective")


X_PAGE_ALTS = "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('<link rel=\"alternate\" hreflang=\"en\" href=\"', url, '\">') ELSE '<link rel=\"alternate\" hreflang=\"de\" href=\"/de\">' END"


@query("page_hreflang", _PAGE + _rule("PAGE_HREFLANG_MISMATCH", "warning", "outcome = 'usable_body' AND page_id % 4 IN (2, 3)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    alts = "array(named_struct('rel', 'alternate', 'hreflang', 'EN', 'href', url, 'media', cast(null as string)))"
    return _found(P.page_hreflang_findings(P.facts(_artifacts(spark, d, X_PAGE_ALTS)), P.declared_alternates(_entries(spark, d, loc="url", alternates=alts))))


@query("page_sample", f"WITH p AS (SELECT min(url) AS loc, {X_CLEAN} AS loc_key FROM pages GROUP BY 2) SELECT loc_key, loc FROM p ORDER BY sha256(loc_key), loc_key LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.select_pages(_table(spark, d, "pages").withColumnRenamed("url", "loc")).select("loc_key", "loc")


# == robots

_ROBOTS = "User-agent: *\\nDisallow: /private\\nAllow: /private/open\\nDisallow: /*.pdf$\\nSitemap: https://{0}/s1.xml\\nsite-map : https://{0}/s2.xml\\nSitemap: /relative.xml\\nSitemap: https://{0}/s1.xml#again\\nUser-agent: special\\nDisallow: /"


def _robots_files(spark: SparkSession, d: str) -> DataFrame:
    host = F.concat(F.regexp_replace(F.lower("n_name"), "[^a-z]", ""), F.col("n_nationkey").cast("string"), F.lit(".example"))
    text = F.regexp_replace(F.lit(_ROBOTS.replace("\\n", "\n")), r"\{0\}", "HOST")
    return _table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("https://"), host).alias("origin"), F.replace(text, F.lit("HOST"), host).alias("text"))


_ORIGIN = "concat('https://', regexp_replace(lower(n_name), '[^a-z]', '', 'g'), CAST(n_nationkey AS VARCHAR), '.example')"
_PATHS = {"/": "allow", "/private": "disallow", "/private/x": "disallow", "/private/open": "allow", "/private/opener": "allow", "/a/b.pdf": "disallow", "/a/b.pdf?x=1": "allow", "/public": "allow"}


@query("robots_decision", "WITH t(path, decision) AS (VALUES " + ", ".join(f"('{p}', '{v}')" for p, v in _PATHS.items()) + f") SELECT concat({_ORIGIN}, path) AS loc, decision FROM nation, t")
def _(spark: SparkSession, d: str) -> DataFrame:
    files = _robots_files(spark, d)
    locs = files.select("origin", F.explode(F.array(*map(F.lit, _PATHS))).alias("p")).select(F.concat("origin", "p").alias("loc"))
    return RB.decide(locs, RB.rules(files)).select("loc", "decision")


@query("robots_directives", f"SELECT {_ORIGIN} AS origin, CAST(line_no AS INTEGER) AS line_no, concat({_ORIGIN}, path) AS sitemap FROM nation, (VALUES (4, '/s1.xml'), (5, '/s2.xml')) t(line_no, path)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return RB.sitemap_directives(_robots_files(spark, d)).select("origin", "line_no", "sitemap")


@query("candidates", "WITH t(ord, path) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate([*discovery.GENERIC, "/wp-sitemap.xml"], 3)) + f"), r AS (SELECT {_ORIGIN} AS root FROM nation) SELECT root, concat(root, path) AS candidate_url, CAST(ord AS INTEGER) AS ord FROM r, t UNION ALL SELECT root, concat(root, '/s1.xml'), 1 FROM r UNION ALL SELECT root, concat(root, '/s2.xml'), 2 FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    files = _robots_files(spark, d)
    named = RB.sitemap_directives(files).withColumnRenamed("origin", "root")
    return discovery.candidates(files.select(F.col("origin").alias("root")), named).select("root", "candidate_url", "ord")


# == index

X_CHILD = f"CASE WHEN page_id % 3 = 0 THEN concat('https://', {X_HOST}, ':443/s.xml') WHEN page_id % 3 = 1 THEN concat('https://', {X_HOST}, '/s.xml') WHEN page_id % 2 = 0 THEN concat('https://other.example/', {X_HOST}) ELSE {X_CLEAN} END"
_CHILD = f"WITH c AS (SELECT page_id, {X_HOST} AS doc_id, {X_CHILD} AS loc, row_number() OVER (PARTITION BY {X_HOST} ORDER BY page_id) AS ix FROM pages), k AS (SELECT *, replace(loc, ':443/', '/') AS key FROM c), f AS (SELECT *, min(ix) OVER (PARTITION BY doc_id, key) AS first FROM k) "


def _children(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://"), "host", F.lit("/idx/index.xml"))
    ix = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return _pages(spark, d).select(F.col("host").alias("doc_id"), U.base_ref(url).alias("base"), url.alias("sitemap_url"), ix.alias("child_ix"), F.expr(X_CHILD).alias("loc"))


@query("index_children_dedup", _CHILD + ", g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS nth FROM f WHERE ix = first) SELECT doc_id, loc, CAST(nth AS INTEGER) AS nth FROM g WHERE nth <= 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.capped_children(_children(spark, d), L.IndexLimits(max_children=4)).select("doc_id", "loc", "nth")


@query("child_scope", _CHILD + "SELECT 'INDEX_CHILD_OUT_OF_SCOPE' AS code, 'warning' AS severity, concat('sitemap://', doc_id, '/idx/index.xml#index-child:', loc) AS subject_ref FROM f WHERE loc LIKE 'http://%' OR loc LIKE 'https://other.example/%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _found(I.child_scope_findings(_children(spark, d), Ruleset("bing")))


@query(
    "index_budget",
    "WITH s AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS n_urls, count(*) OVER w AS sitemaps, sum(CAST(floor(value) AS BIGINT)) OVER w AS urls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "b AS (SELECT *, max(CASE WHEN sitemaps > 5 OR urls > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS cut FROM s) SELECT event_id, CAST(sitemaps AS BIGINT) AS sitemaps, CAST(urls AS BIGINT) AS urls, cut = 0 AS kept FROM b",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    leaves = _table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("n_urls"))
    return I.within_budget(leaves, L.IndexLimits(max_total_sitemaps=5, max_total_urls=300), ["user_id"], "event_id").select("event_id", "sitemaps", "urls", "kept")


# == findings, reports


def _assembled(spark: SparkSession, d: str, mode: str, ruleset: Ruleset | None = None) -> DataFrame:
    e = E.keyed(_entries(spark, d))
    return assemble(spark, [E.loc_findings(e, ruleset), E.field_findings(e, ruleset), D.identical_lastmod(e, L.ProtocolLimits(lastmod_identical_ratio=0.5))], mode, ruleset, ordered=False)


def _all(strict: bool, yandex: bool = False, scope: str | None = None) -> str:
    low = "warning" if yandex else "error"
    rules = [
        _rule("PROTOCOL_URL_NOT_ABSOLUTE", "error", "page_id % 16 IN (2, 3)"), _rule("PROTOCOL_URL_NO_HOST", "error", "page_id % 16 = 6"), _rule("PROTOCOL_URL_INVALID_ESCAPE", "error", "page_id % 16 = 1"),
        _rule("PROTOCOL_URL_NOT_ESCAPED", "warning", "page_id % 16 = 0"), _rule("PROTOCOL_URL_NOT_ESCAPED", "info", "page_id % 16 = 5"), _rule("PROTOCOL_URL_FRAGMENT", "info", "live AND contains(loc, '#')"),
        _rule("PROTOCOL_URL_USERINFO", "info", "page_id % 16 = 4"),
        _rule("PROTOCOL_URL_OUT_OF_SCOPE", "warning", scope or "live AND NOT (url LIKE 'https://%' AND regexp_matches(url, '^[a-z]+://[^/]*/en/'))"),
        _rule("PROTOCOL_PRIORITY_OUT_OF_RANGE", low, "page_id % 6 IN (1, 2)"), _rule("PROTOCOL_CHANGEFREQ_INVALID", low, "changefreq IN ('Daily', 'often')"), _rule("PROTOCOL_LASTMOD_INVALID", low, "page_id % 7 IN (2, 3, 6)"),
    ]
    if strict:
        rules.append(_rule("PROTOCOL_LASTMOD_DATE_ONLY", "info", "page_id % 7 = 0"))
    same = f"WITH e0 AS (SELECT {X_HOST} AS host, {_INSTANT} AS t FROM pages), n AS (SELECT host, t, count(*) AS c FROM e0 WHERE t IS NOT NULL GROUP BY host, t), h AS (SELECT concat('sitemap://', host, '/en/sitemap.xml') AS ref, max(c) AS most, sum(c) AS n FROM n GROUP BY host), "
    rules.append("SELECT 'PROTOCOL_LASTMOD_ALL_IDENTICAL', 'warning', ref FROM h WHERE n >= 2 AND most / n >= 0.5")
    return _ENTRIES.replace("WITH ", same, 1) + " UNION ALL ".join(rules)


@query("findings_assemble_strict", f"SELECT *, 'strict' AS mode FROM ({_all(True)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, "strict").select("code", "severity", "subject_ref", "mode")


@query("findings_assemble_nonstrict", f"SELECT *, 'non-strict' AS mode FROM ({_all(False)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, "non-strict").select("code", "severity", "subject_ref", "mode")


_STAMP = "SELECT *, '{0}' AS ruleset, CASE WHEN code IN ({1}) THEN 'documented' ELSE 'inherited_protocol' END AS provenance FROM ({2})"


@query("ruleset_google", _STAMP.format("google", "'PROTOCOL_URL_OUT_OF_SCOPE'", _all(True, scope="live AND url NOT LIKE 'https://%' AND concat(regexp_extract(url, '^[a-z]+://[^/?#]*', 0)) <> 'http://ththon.example.com'")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, "strict", Ruleset("google", gsc_submission("http://ththon.example.com/"))).select("code", "severity", "subject_ref", "ruleset", "provenance")


@query("ruleset_yandex", _STAMP.format("yandex", "'PROTOCOL_URL_OUT_OF_SCOPE', 'PROTOCOL_PRIORITY_OUT_OF_RANGE', 'PROTOCOL_CHANGEFREQ_INVALID', 'PROTOCOL_LASTMOD_INVALID'", _all(True, True)))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, "strict", Ruleset("yandex")).select("code", "severity", "subject_ref", "ruleset", "provenance")


@query("severity_counts", f"SELECT 0::BIGINT AS fatal, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM ({_all(True)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.severity_counts(_assembled(spark, d, "strict"))


@query("finding_samples", f"SELECT 'protocol' AS layer, code, CASE min(CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n, min(subject_ref) AS sample_ref FROM ({_all(True)}) GROUP BY code")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.finding_samples(_assembled(spark, d, "strict")).select("layer", "code", "severity", "n", "sample_ref")


@query("lastmod_histogram", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.lastmod_histogram(_table(spark, d, "orders").select(F.col("o_orderdate").alias("lastmod")))


_FOLDERS = "WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages), e AS (SELECT p, unnest(range(0, len(p) + 1)) AS depth FROM p) "


@query("folder_tree", _FOLDERS + "SELECT array_to_string(p[1:depth], '/') AS prefix, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM e GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.folder_tree(_table(spark, d, "pages").select(F.col("url").alias("loc")))


@query("source_counts", _ENTRIES + "SELECT concat('https://', host, '/en/sitemap.xml') AS source_sitemap, count(*) AS n, bool_or(page_id % 7 IN (0, 1, 5)) AS has_lastmod, bool_or(page_id % 6 NOT IN (3, 4)) AS has_priority, bool_or(changefreq IS NOT NULL) AS has_changefreq FROM f GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.documents import urls

    return R.source_counts(urls(_entries(spark, d)))


_OLD = "SELECT CAST(o_orderkey AS VARCHAR) AS loc, o_orderpriority AS changefreq FROM orders WHERE o_orderkey % 10 <> 3"
_NEW = "SELECT CAST(o_orderkey AS VARCHAR) AS loc, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS changefreq FROM orders WHERE o_orderkey % 10 <> 4"


@query(
    "audit_diff",
    f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT 'added' AS change, loc FROM n WHERE loc NOT IN (SELECT loc FROM o) UNION ALL SELECT 'removed', loc FROM o WHERE loc NOT IN (SELECT loc FROM n) UNION ALL SELECT 'changed', o.loc FROM o JOIN n ON o.loc = n.loc WHERE o.changefreq <> n.changefreq",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("loc"), F.col("o_orderpriority").alias("changefreq"))
    old = t.where("o_orderkey % 10 <> 3").drop("o_orderkey")
    new = t.where("o_orderkey % 10 <> 4").withColumn("changefreq", F.when(F.col("o_orderkey") % 7 == 0, "changed").otherwise(F.col("changefreq"))).drop("o_orderkey")
    parts = DF.diff(old, new, ["loc"])
    rows = [parts[k].select(F.lit(k).alias("change"), "loc") for k in ("added", "removed")]
    return rows[0].unionByName(rows[1]).unionByName(parts["changed"].select(F.lit("changed").alias("change"), F.get_json_object("key", "$.loc").alias("loc")))


# == bytes and text

_WRAP = {0: ("", "html"), 1: ("<!-- c --><?pi x?><urlset>", "xml-urlset"), 2: ("<s:sitemapindex >", "xml-sitemapindex"), 3: ("<rss>", "feed"), 4: ("<note>", "xml"), 5: ("plain ", "text")}


@query("sniff", "SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in _WRAP.items()) + " END AS format FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.create_map(*[F.lit(x) for k, (v, _) in _WRAP.items() for x in (k, v)]), (F.col("page_id") % 6).cast("int"))
    return _table(spark, d, "pages").select("page_id", raw.sniff_column(F.encode(F.concat(head, "html"), "UTF-8")).alias("format"))


@query(
    "text_lines",
    "WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS raw, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS n FROM documents), "
    "f AS (SELECT concat('sitemap://doc', CAST(doc_id AS VARCHAR), '#line:', CAST(n AS VARCHAR)) AS ref, trim(raw, ' \t\r\n') AS loc FROM l) "
    + _rule("PROTOCOL_TEXT_BLANK_LINE", "info", "loc = ''") + " UNION ALL " + _rule("PROTOCOL_URL_NOT_ABSOLUTE", "error", "loc <> '' AND NOT regexp_matches(loc, '^(?i:https?)://')"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_id"), F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "raw"))
    return _found(E.text_findings(lines.select("doc_id", F.concat(F.lit("sitemap://"), "doc_id").alias("base"), (F.col("i") + 1).alias("line_no"), "raw")))


@query("nav_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("page_facts")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "pages").select(F.col("url").alias("loc"), F.col("url").alias("final_url"), F.lit("usable_body").alias("outcome"), F.encode("html", "UTF-8").alias("body"), F.expr("map('Content-Type', array('text/html'))").alias("headers"))
    return P.facts(rows).select("loc", F.size("canonicals").alias("canonicals"), F.size("alternates").alias("alternates"), F.size("directives").alias("directives"))



# == robots groups and findings

_GROUPS = {
    0: "User-agent: Bot/1.0\nDisallow:\n\nUser-agent: *\nDisallow: /", 1: "User-agent: bot\nDisallow: /a\nUser-agent: *\nDisallow: /", 2: "User-agent: other\nDisallow: /",
    3: "User-agent: *\nDisallow: /%C3%BC\nAllow: /ü/open\nDisallow: /*z*z$",
}
_ASKED = ("/", "/a/b", "/ü", "/ü/open", "/zoo", "/zz")


@query(
    "robots_groups",
    "WITH t(path) AS (VALUES " + ", ".join(f"('{p}')" for p in _ASKED) + f") SELECT concat({_ORIGIN}, path) AS loc, CASE WHEN n_nationkey % 4 = 1 AND path = '/a/b' OR n_nationkey % 4 = 3 AND path IN ('/ü', '/zz') THEN 'disallow' ELSE 'allow' END AS decision FROM nation, t",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.create_map(*[F.lit(x) for kv in _GROUPS.items() for x in kv]), (F.col("n_nationkey") % 4).cast("int"))
    files = _robots_files(spark, d).withColumn("text", text)
    locs = files.select("origin", F.explode(F.array(*map(F.lit, _ASKED))).alias("p")).select(F.concat("origin", "p").alias("loc"))
    return RB.decide(locs, RB.rules(files), agent="Bot/2.3").select("loc", "decision")


_STATE = "CASE n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'absent' ELSE 'timeout' END"


@query(
    "robots_findings",
    f"WITH n AS (SELECT {_ORIGIN} AS origin, {_STATE} AS state FROM nation), l AS (SELECT origin, state, concat('sitemap', substr(origin, 6), '/private/s.xml') AS base, path FROM n, (VALUES ('/private/x'), ('/free')) t(path)), f AS (SELECT *, concat(base, '#page-url:', origin, path) AS ref FROM l) "
    + _rule("ROBOTS_DISALLOWED", "warning", "state = 'ok' AND path = '/private/x'") + " UNION ALL " + _rule("ROBOTS_INDETERMINATE", "info", "state = 'timeout'") + " UNION ALL " + _rule("ROBOTS_SITEMAP_DISALLOWED", "warning", "state = 'ok' AND path = '/free'", "base"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    files = _robots_files(spark, d)
    states = files.select("origin", F.expr(_STATE).alias("state"))
    sites = files.select(F.concat("origin", F.lit("/private/s.xml")).alias("sitemap_url")).select(U.base_ref(F.col("sitemap_url")).alias("base"), "sitemap_url")
    subjects = files.select(U.base_ref(F.concat("origin", F.lit("/private/s.xml"))).alias("base"), F.explode(F.array(F.concat("origin", F.lit("/private/x")), F.concat("origin", F.lit("/free")))).alias("loc"))
    decisions = RB.decide(subjects.select("loc").unionByName(sites.select(F.col("sitemap_url").alias("loc"))), RB.rules(files), states)
    return _found(RB.robots_findings(subjects, decisions).unionByName(RB.robots_sitemap_findings(sites, decisions)))


# == order, messages, evidence


@query(
    "findings_order",
    f"WITH a AS ({_all(True)}) SELECT code, severity, subject_ref, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, subject_ref, code) - 1 AS place FROM a",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import order
    from ..storage import Workspace

    found = Workspace(spark, "order").table(_assembled(spark, d, "strict"), "findings")
    return order(found).select("code", "severity", "subject_ref").coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("text_url_too_long", f"WITH f AS (SELECT page_id, concat('sitemap://t#line:', CAST(page_id AS VARCHAR)) AS ref, concat({X_CLEAN}, '/', repeat('a', 2040 - length({X_CLEAN}) + CAST(page_id % 16 AS INTEGER))) AS loc FROM pages) SELECT 'PROTOCOL_TEXT_URL_TOO_LONG' AS code, 'warning' AS severity, ref AS subject_ref, concat('The URL has ', CAST(length(loc) AS VARCHAR), ' characters; 2047 are allowed.') AS message, page_id AS line, substr(loc, 1, 200) AS excerpt FROM f WHERE length(loc) >= 2048")
def _(spark: SparkSession, d: str) -> DataFrame:
    loc = F.expr(f"concat({X_CLEAN}, '/', repeat('a', cast(2040 - length({X_CLEAN}) + page_id % 16 as int)))")
    lines = _table(spark, d, "pages").select(F.lit("t").alias("doc_id"), F.lit("sitemap://t").alias("base"), F.col("page_id").alias("line_no"), loc.alias("raw"))
    return E.text_findings(lines).select("code", "severity", "subject_ref", "message", F.col("evidence.line").cast("long").alias("line"), "evidence.excerpt")


@query(
    "noindex_findings",
    _PAGE + ", n AS (SELECT *, regexp_extract(ref, '#page-url:(.*)$', 1) AS loc, page_id % 4 = 0 AS m, page_id % 6 IN (0, 1) AS h, page_id % 4 = 1 OR page_id % 6 = 2 AS x FROM f WHERE outcome IN ('usable_body', 'partial')), g AS (SELECT *, CASE WHEN x THEN 'conflict' WHEN m AND h THEN 'cross_channel' ELSE 'single_channel' END AS path, concat(CASE WHEN NOT x THEN '; yandex leaves it out of the index' ELSE '; yandex still indexes it' END, '.') AS verdict FROM n WHERE m OR h) "
    "SELECT 'PAGE_META_ROBOTS_NOINDEX' AS code, ref AS subject_ref, path AS excerpt, concat(loc, ' says noindex in its robots meta element', verdict) AS message FROM g WHERE m "
    "UNION ALL SELECT 'PAGE_XROBOTSTAG_NOINDEX', ref, path, concat(loc, ' says noindex in its X-Robots-Tag header', verdict) FROM g WHERE h",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.noindex_findings(P.facts(_artifacts(spark, d, X_META, X_HEADERS)), Ruleset("yandex")).select("code", "subject_ref", "evidence.excerpt", "message")


# == whole documents, from bytes

X_ESCAPED = "replace(replace(url, '&', '&amp;'), 'e', '&#101;')"
_KIND = {0: "urlset", 1: "index", 2: "text", 3: "urlset", 4: "feed"}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for each host, of its pages: sitemaps with comments, sections and references, an index, a text file, a feed."""
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = _table(spark, d, "pages").select("page_id", "url", F.expr(f"{X_HOST} AS host"), F.expr(f"{X_ESCAPED} AS escaped"))
    rows = rows.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("page_id", "url", "escaped"))).alias("p"), F.min("page_id").alias("k"))
    each = lambda before, what, after, sep="": F.array_join(F.transform("p", lambda x: F.concat(F.lit(before), x[what], F.lit(after))), sep)
    text = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit(f"<?xml version='1.0'?><!-- c --><urlset {ns}>"), each("<url><!-- x --><loc> ", "escaped", "\n</loc><priority>0.5</priority></url>"), F.lit("</urlset>")))
        .when(F.col("k") % 5 == 1, F.concat(F.lit(f"<sitemapindex {ns}>"), each("<sitemap><loc>", "escaped", "</loc></sitemap>"), F.lit("</sitemapindex>")))
        .when(F.col("k") % 5 == 2, each("", "url", "", "\r\n"))
        .when(F.col("k") % 5 == 3, F.concat(F.lit(f"<s:urlset {ns.replace('xmlns', 'xmlns:s')}>"), each("<s:url><s:loc><![CDATA[", "url", "]]></s:loc></s:url>"), F.lit("</s:urlset>")))
        .otherwise(F.concat(F.lit('<rss version="2.0"><channel>'), each("<item><link>", "escaped", "</link></item>"), F.lit("</channel></rss>")))
    )
    null = lambda kind: F.lit(None).cast(kind)
    url = F.concat(F.lit("https://"), "host", F.lit("/s"))
    content = F.encode(text, "UTF-8")
    return rows.select(
        F.col("host").alias("doc_id"), url.alias("requested_url"), url.alias("final_url"), null("string").alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("byte_size"), F.lit(200).alias("status"),
        null("string").alias("content_type"), null("timestamp").alias("fetched_at"), null("string").alias("error_class"),
    )


_PARSED = f"WITH p AS (SELECT page_id, url, {X_HOST} AS host, row_number() OVER (PARTITION BY {X_HOST} ORDER BY page_id) AS ix, min(page_id) OVER (PARTITION BY {X_HOST}) % 5 AS k FROM pages) "


@query("parsed_kinds", _PARSED + "SELECT host AS doc_id, CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _KIND.items()) + " END AS kind, CAST(CASE WHEN k = 1 THEN 0 ELSE count(*) END AS INTEGER) AS entries, CAST(CASE WHEN k = 1 THEN count(*) ELSE 0 END AS INTEGER) AS children FROM p GROUP BY host, k")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import documents as S

    return S.parse(_documents(spark, d)).select("doc_id", "kind", F.size("entries").alias("entries"), F.size("children").alias("children"))


@query("parsed_entries", _PARSED + "SELECT host AS doc_id, CAST(ix AS INTEGER) AS entry_ix, url AS loc, CASE WHEN k = 0 THEN '0.5' END AS priority FROM p WHERE k <> 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import documents as S

    return S.entries(S.with_base(S.parse(_documents(spark, d)))).select("doc_id", "entry_ix", "loc", "priority")


@query("parsed_children", _PARSED + "SELECT host AS doc_id, CAST(ix AS INTEGER) AS child_ix, url AS loc FROM p WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import documents as S

    return S.children(S.with_base(S.parse(_documents(spark, d)))).select("doc_id", "child_ix", "loc")
