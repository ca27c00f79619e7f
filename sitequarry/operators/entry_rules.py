"""Rules of one entry: a single scan of the entries evaluates all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import values as V
from ..limits import ProtocolLimits
from ..rulesets import Ruleset
from ..schema import CHANGEFREQ
from .findings import Finding, finding, hits

_CUT = 120


def entry_ref(base: Column, ix: Column, more: Column | str = "") -> Column:
    return F.concat(base, F.lit("#entry:"), ix.cast("string"), more if isinstance(more, Column) else F.lit(more))


def _show(x: Column) -> Column:
    return F.concat(F.lit("'"), F.substring(x, 1, _CUT), F.lit("'"))


def out_of_scope(url: Column, self_url: Column, ruleset: Ruleset | None) -> Column:
    """Not the sitemap's authority, or not at or below its directory; engines waive parts of it."""
    own = U.authority(url)
    ok = own == U.authority(self_url)
    if not (ruleset and ruleset.name == "google" and ruleset.context.submission_channel == "search_console_api"):
        ok = ok & F.coalesce(url["path"], F.lit("/")).startswith(U.directory(self_url["path"]))
    out = self_url["host"].isNotNull() & url["host"].isNotNull() & ~F.coalesce(ok, F.lit(False))
    if ruleset and ruleset.authority_established:
        if ruleset.context.authority_evidence != "verified_property_set":
            return F.lit(False)
        scope = U.canonical(ruleset.context.property_scope or "")
        if scope:
            scheme, host, port = scope[:3]
            default = (scheme, port) in (("http", 80), ("https", 443))
            out = out & (own != F.lit(f"{scheme}://{host}" + ("" if port is None or default else f":{port}")))
    return out


def keyed(entries: DataFrame) -> DataFrame:
    """Entries with ``url`` and ``loc_key``, and the sitemap's own components as ``self``."""
    return U.with_url(U.with_url(entries, "sitemap_url", "self", "self_key"))


def loc_findings(entries: DataFrame, ruleset: Ruleset | None = None) -> DataFrame:
    """URL rules of XML entries. ``entries``: as ``keyed`` gives them."""
    loc, url = F.col("loc"), F.col("url")
    ref, kind = entry_ref(F.col("base"), F.col("entry_ix")), U.absoluteness(F.col("loc"))
    http, host = kind == "http(s)", url["host"].isNotNull()
    live = http & host

    def f(code: str, message: Column, **kw) -> Finding:
        return finding(code, ref, message, excerpt=loc, **kw)

    illegal, foreign = U.illegal_char(loc), U.non_ascii(loc)
    rules = [
        (loc.isNotNull() & ~http, f("PROTOCOL_URL_NOT_ABSOLUTE", F.concat(_show(loc), F.lit(" is no absolute http(s) URL.")))),
        (http & ~host, f("PROTOCOL_URL_NO_HOST", F.concat(_show(loc), F.lit(" names no host.")))),
        (live & (F.char_length(loc) >= 2048), f("PROTOCOL_URL_TOO_LONG", F.concat(F.lit("The URL has "), F.char_length(loc).cast("string"), F.lit(" characters; 2047 are allowed.")))),
        (live & U.invalid_escape(loc), f("PROTOCOL_URL_INVALID_ESCAPE", F.concat(_show(loc), F.lit(" has a % without two hex digits.")))),
        (live & illegal, f("PROTOCOL_URL_NOT_ESCAPED", F.concat(_show(loc), F.lit(" holds a character that must be percent-encoded.")))),
        (
            live & ~illegal & foreign,
            f("PROTOCOL_URL_NOT_ESCAPED", F.concat(_show(loc), F.lit(" is written unencoded; it is fetched as "), F.col("loc_key"), F.lit(".")), severity="info"),
        ),
        (live & loc.contains("#"), f("PROTOCOL_URL_FRAGMENT", F.concat(_show(loc), F.lit(" has a fragment, which is never requested.")))),
        (live & url["user"].isNotNull(), f("PROTOCOL_URL_USERINFO", F.concat(_show(loc), F.lit(" carries user information.")))),
        (
            live & out_of_scope(url, F.col("self"), ruleset),
            f("PROTOCOL_URL_OUT_OF_SCOPE", F.concat(_show(loc), F.lit(" lies outside the host and directory of "), F.col("sitemap_url"), F.lit("."))),
        ),
    ]
    if ruleset and ruleset.name == "yandex":
        n = U.decoded_length(loc)
        rules.append((live & (n > 1024), f("PROTOCOL_URL_DECODED_TOO_LONG", F.concat(F.lit("The decoded URL has "), n.cast("string"), F.lit(" characters; 1024 are taken.")))))
    return hits(entries, *rules)


def field_findings(entries: DataFrame, ruleset: Ruleset | None = None) -> DataFrame:
    """Values of lastmod, changefreq and priority; under yandex also the size of each tag."""
    ref = entry_ref(F.col("base"), F.col("entry_ix"))
    cls, p = V.lastmod_class(F.col("lastmod")), V.parse_priority(F.col("priority"))

    def f(code: str, column: str, text: str) -> Finding:
        return finding(code, ref, F.concat(F.lit(f"{column} "), _show(F.col(column)), F.lit(text)), excerpt=F.col(column))

    rules = [
        (p.isNotNull() & ~((p >= 0) & (p <= 1)), f("PROTOCOL_PRIORITY_OUT_OF_RANGE", "priority", " is not within 0.0 and 1.0.")),
        (~F.col("changefreq").isin(*CHANGEFREQ), f("PROTOCOL_CHANGEFREQ_INVALID", "changefreq", " is none of the seven values.")),
        (cls == "invalid", f("PROTOCOL_LASTMOD_INVALID", "lastmod", " is neither a date nor a date-time with a zone.")),
        (cls == "date-only", f("PROTOCOL_LASTMOD_DATE_ONLY", "lastmod", " has no time of day.")),
    ]
    if ruleset and ruleset.name == "yandex":
        for column, most in (("loc", 1500), ("lastmod", 100), ("changefreq", 100), ("priority", 100)):
            size = F.octet_length(column)
            rules.append(
                (size >= most, finding("PROTOCOL_TAG_DATA_LIMIT_EXCEEDED", ref, F.concat(F.lit(f"<{column}> holds "), size.cast("string"), F.lit(f" bytes; fewer than {most} are taken.")), excerpt=F.col(column)))
            )
    return hits(entries, *rules)


def duplicate_findings(entries: DataFrame) -> DataFrame:
    """Repeated locs point to the first entry of the same spelling; first spellings of a known key to the first entry with the key.

    Two windows over one shuffle: the spelling's minimum is taken within the key's partition, as equal spellings have equal keys.
    """
    rows = entries.where((U.absoluteness(F.col("loc")) == "http(s)") & F.col("url.host").isNotNull()).select("doc_id", "base", "entry_ix", "loc", "loc_key")
    by_key = Window.partitionBy("doc_id", "loc_key")
    rows = rows.withColumn("first_key", F.min("entry_ix").over(by_key)).withColumn("first_raw", F.min("entry_ix").over(Window.partitionBy("doc_id", "loc_key", "loc")))
    ref, ix = entry_ref(F.col("base"), F.col("entry_ix")), F.col("entry_ix")
    return hits(
        rows,
        (ix > F.col("first_raw"), finding("PROTOCOL_DUPLICATE_LOC", ref, F.concat(F.lit("The same loc stands in entry "), F.col("first_raw").cast("string"), F.lit(".")), excerpt=F.col("loc"))),
        (
            (ix == F.col("first_raw")) & (ix > F.col("first_key")),
            finding("PROTOCOL_URL_EQUIVALENT", ref, F.concat(F.lit("Entry "), F.col("first_key").cast("string"), F.lit(" most likely names the same page: "), F.col("loc_key")), excerpt=F.col("loc")),
        ),
    )


def extension_findings(entries: DataFrame, limits: ProtocolLimits = ProtocolLimits()) -> DataFrame:
    """Image counts, and the fields of video and news elements: a finding for each thing wrong."""
    ref = entry_ref(F.col("base"), F.col("entry_ix"))
    n = F.size("images")
    images = hits(entries.select("base", "entry_ix", "images"), (n > limits.max_images_per_url, finding("PROTOCOL_IMAGE_COUNT_EXCEEDED", ref, F.concat(n.cast("string"), F.lit(f" images; {limits.max_images_per_url} are allowed for a URL.")))))

    videos = entries.where(F.size("video") > 0).select("base", "entry_ix", F.posexplode("video").alias("m", "v"))
    v = lambda name: F.col(f"v.{name}")
    at = entry_ref(F.col("base"), F.col("entry_ix"), F.concat(F.lit(":video:"), (F.col("m") + 1).cast("string")))
    seconds, rating = V.parse_priority(v("duration")), V.parse_priority(v("rating"))

    def wrong(name: str, text: str) -> Finding:
        return finding("PROTOCOL_VIDEO_FIELD_INVALID", at, F.concat(F.lit(f"video {name} "), F.coalesce(_show(v(name)), F.lit("")), F.lit(text)), excerpt=v(name))

    rules = [
        (v("duration").isNotNull() & ~F.coalesce(U.trim4(v("duration")).rlike(r"^[0-9]+$") & seconds.between(1, 28800), F.lit(False)), wrong("duration", " is no whole number of seconds from 1 to 28800.")),
        (v("rating").isNotNull() & ~F.coalesce(rating.between(0, 5), F.lit(False)), wrong("rating", " is not within 0 and 5.")),
        (F.size(v("tags")) > limits.max_video_tags, finding("PROTOCOL_VIDEO_FIELD_INVALID", at, F.concat(F.size(v("tags")).cast("string"), F.lit(f" video tags; {limits.max_video_tags} are allowed.")))),
        (F.char_length(v("description")) > 2048, finding("PROTOCOL_VIDEO_FIELD_INVALID", at, F.concat(F.lit("The video description has "), F.char_length(v("description")).cast("string"), F.lit(" characters; 2048 are allowed.")))),
        *[(~v(name).isin("yes", "no"), wrong(name, " is neither yes nor no.")) for name in ("family_friendly", "requires_subscription", "live")],
        *[
            (v(f"has_{name}") & ~F.coalesce(v(f"{name}_relationship").isin("allow", "deny"), F.lit(False)), wrong(name, " has no relationship allow or deny."))
            for name in ("restriction", "platform")
        ],
    ]
    news = entries.where(F.size("news") > 0).select("base", "entry_ix", F.explode("news").alias("n"))
    lang, date = F.col("n.publication.language"), F.col("n.publication_date")
    return (
        images.unionByName(hits(videos, *rules))
        .unionByName(
            hits(
                news,
                (lang.isNotNull() & ~lang.rlike("^([a-z]{2,3}|zh-cn|zh-tw)$"), finding("PROTOCOL_NEWS_FIELD_INVALID", ref, F.concat(F.lit("news language "), _show(lang), F.lit(" is no language code.")), excerpt=lang)),
                (date.isNotNull() & V.parse_lastmod(date).isNull(), finding("PROTOCOL_NEWS_FIELD_INVALID", ref, F.concat(F.lit("news publication_date "), _show(date), F.lit(" is no date.")), excerpt=date)),
            )
        )
    )


def links(entries: DataFrame) -> DataFrame:
    """(doc_id, base, entry_ix, loc, link_ix, rel, hreflang, href): the entries' alternates."""
    return entries.where(F.size("alternates") > 0).select("doc_id", "base", "entry_ix", "loc", F.posexplode("alternates").alias("__m", "a")).select(
        "doc_id", "base", "entry_ix", "loc", (F.col("__m") + 1).alias("link_ix"), "a.rel", "a.hreflang", "a.href"
    )


def hreflang_findings(alternates: DataFrame) -> DataFrame:
    """Rules of the alternates within one entry; ``alternates`` as ``links`` gives them."""
    token = F.lower(U.trim4(F.col("hreflang")))
    code = V.hreflang_code(F.col("hreflang"))
    clean = F.col("hreflang") == "x-default"
    is_default = F.translate(token, "_", "-") == "x-default"
    entry = ["doc_id", "entry_ix"]
    rows = (
        alternates.withColumn("token", F.when(F.col("hreflang").isNotNull() & ~is_default & (token != ""), token))
        .withColumn("first", F.min("link_ix").over(Window.partitionBy(*entry, "token")))
        .withColumn("nth", F.when(clean, F.sum(clean.cast("int")).over(Window.partitionBy(*entry).orderBy("link_ix"))))
    )
    ref = entry_ref(F.col("base"), F.col("entry_ix"), F.concat(F.lit(":link:"), F.col("link_ix").cast("string")))
    raw, href = F.col("hreflang"), F.col("href")
    blank = href.isNull() | (U.trim4(href) == "")
    attrs = F.col("rel").isNull() | (F.col("rel") != "alternate") | raw.isNull() | blank
    text = {
        "HREFLANG_FORMAT_INVALID": " is no language token.",
        "HREFLANG_SEPARATOR_INVALID": " is not separated by single hyphens.",
        "HREFLANG_NONSTANDARD_CASE": " is not in the usual case.",
        "HREFLANG_XDEFAULT_INVALID": " is not exactly x-default.",
    }
    per_link = hits(
        rows,
        *[(code == c, finding(c, ref, F.concat(F.lit("hreflang "), _show(raw), F.lit(t)), excerpt=raw)) for c, t in text.items()],
        (attrs, finding("HREFLANG_LINK_ATTR_INVALID", ref, F.lit("The link needs rel=alternate, an hreflang and an href."), excerpt=F.coalesce(href, raw))),
        (~blank & (U.absoluteness(href) == "relative"), finding("HREFLANG_HREF_RELATIVE", ref, F.concat(F.lit("href "), _show(href), F.lit(" is relative.")), excerpt=href)),
        (F.col("token").isNotNull() & (F.col("link_ix") > F.col("first")), finding("HREFLANG_DUPLICATE", ref, F.concat(F.lit("hreflang "), _show(raw), F.lit(" stands in link "), F.col("first").cast("string"), F.lit(" already.")), excerpt=raw)),
        (F.col("nth") > 1, finding("HREFLANG_XDEFAULT_INVALID", ref, F.lit("A second x-default in one entry."), excerpt=raw)),
    )
    sets = alternates.groupBy("doc_id", "base", "entry_ix").agg(F.bool_or(raw.isNotNull()).alias("any"), F.bool_or(is_default).alias("has"))
    return per_link.unionByName(
        hits(sets, (F.col("any") & ~F.coalesce(F.col("has"), F.lit(False)), finding("HREFLANG_XDEFAULT_MISSING", entry_ref(F.col("base"), F.col("entry_ix")), F.lit("The alternates have no x-default."))))
    )


def text_findings(lines: DataFrame) -> DataFrame:
    """Rules of plain-text sitemaps; ``lines``: doc_id, base, line_no, raw (physical lines)."""
    raw, n = F.col("raw"), F.col("line_no")
    loc = U.trim4(raw)
    rows = U.with_url(lines.withColumn("loc", loc))
    ref = F.concat(F.col("base"), F.lit("#line:"), n.cast("string"))
    http, host, blank = U.absoluteness(F.col("loc")) == "http(s)", F.col("url.host").isNotNull(), F.col("loc") == ""

    def f(code: str, message: Column) -> Finding:
        return finding(code, ref, message, excerpt=F.substring(raw, 1, 200), line=n)

    return hits(
        rows,
        (blank, f("PROTOCOL_TEXT_BLANK_LINE", F.lit("A blank line."))),
        (~blank & ~http, f("PROTOCOL_URL_NOT_ABSOLUTE", F.concat(_show(F.col("loc")), F.lit(" is no absolute http(s) URL.")))),
        (http & ~host, f("PROTOCOL_URL_NO_HOST", F.concat(_show(F.col("loc")), F.lit(" names no host.")))),
        (http & host & (F.char_length("loc") >= 2048), f("PROTOCOL_TEXT_URL_TOO_LONG", F.concat(F.lit("The URL has "), F.char_length("loc").cast("string"), F.lit(" characters; 2047 are allowed.")))),
    )
