"""Page inspection: which pages, what was fetched, what the pages say about themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import html as H
from ..functions import urls as U
from ..limits import PageBudget
from ..rulesets import CRAWLERS, Ruleset
from .findings import finding, hits

OUTCOMES = ("usable_body", "partial", "http_status", "redirect_over_budget", "transport_fail", "incomplete", "http_protocol_error", "safety_refused", "skipped")
ARTIFACT = (
    "loc string, requested_url string, final_url string, status int, hops array<struct<url:string,status:int,location:string>>, "
    "headers map<string,array<string>>, body binary, truncated boolean, outcome string"
)

_HOPS = "array<struct<url:string,status:int,location:string>>"


def select_pages(locs: DataFrame, sample: int | None = 50) -> DataFrame:
    """Pages to inspect: one URL an identity (the least spelling), the first ``sample`` by a hash of the key; all for None."""
    keyed = U.with_url(locs.where(F.col("loc").isNotNull()).select("loc")).where((U.absoluteness(F.col("loc")) == "http(s)") & F.col("url.host").isNotNull())
    pages = keyed.groupBy("loc_key").agg(F.min("loc").alias("loc"))
    return pages if sample is None else pages.orderBy(F.sha2("loc_key", 256), "loc_key").limit(sample)


def page_ref(base: Column, loc: Column) -> Column:
    return F.concat(base, F.lit("#page-url:"), loc)


def latest(artifacts: DataFrame, order: str = "requested_url") -> DataFrame:
    """One artifact a loc, the last by ``order``."""
    w = Window.partitionBy("loc").orderBy(F.desc(order))
    return artifacts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def transport_findings(artifacts: DataFrame) -> DataFrame:
    """``artifacts``: ``ARTIFACT`` with ``base``. A usable body under another key than asked for is a redirect."""
    rows = U.with_url(U.with_url(artifacts, "requested_url", "__r", "requested_key"), "final_url", "__f", "final_key")
    ref, out, loc = page_ref(F.col("base"), F.col("loc")), F.col("outcome"), F.col("loc")
    usable = out.isin("usable_body", "partial")
    return hits(
        rows,
        (out.isin("transport_fail", "incomplete", "http_protocol_error"), finding("PAGE_FETCH_FAILED", ref, F.concat(loc, F.lit(" could not be fetched: "), out), excerpt=out)),
        (out == "safety_refused", finding("PAGE_SSRF_BLOCKED", ref, F.concat(loc, F.lit(" was refused for safety.")), excerpt=out)),
        (out == "http_status", finding("PAGE_STATUS_ERROR", ref, F.concat(loc, F.lit(" answers with status "), F.col("status").cast("string")), excerpt=F.concat(F.lit("HTTP "), F.col("status").cast("string")))),
        (usable & (F.col("requested_key") != F.col("final_key")), finding("PAGE_STATUS_REDIRECT", ref, F.concat(loc, F.lit(" redirects to "), F.col("final_url")), excerpt=F.col("final_url"))),
        (out == "redirect_over_budget", finding("PAGE_REDIRECT_CHAIN", ref, F.concat(loc, F.lit(" redirects more often than allowed.")), excerpt=F.concat(F.size("hops").cast("string"), F.lit(" hops")))),
    )


def facts(artifacts: DataFrame) -> DataFrame:
    """Artifacts with the facts of their pages, without the bodies. One parse a page."""
    keep = [c for c in artifacts.columns if c not in ("body", "headers")]
    extra: StructType = _parse_datatype_string(H.FACTS)  # type: ignore[assignment]
    schema = StructType([*(f for f in artifacts.select(*keep).schema), *extra, *_parse_datatype_string("is_html boolean")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                headers = dict(r["headers"] or [])
                kind = next((v[0] for k, v in headers.items() if k.lower() == "content-type" and v), None)
                found = H.page_facts(r["body"], headers, r["final_url"])
                rows.append({k: r[k] for k in keep} | found | {"is_html": kind is None or "html" in kind.lower()})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return artifacts.select(*keep, "headers", "body").mapInArrow(run, schema)


def canonical_findings(pages: DataFrame) -> DataFrame:
    """``pages``: as ``facts`` gives them. Several canonicals of one identity are consistent."""
    rows = U.with_url(pages)
    ref, loc, keys = page_ref(F.col("base"), F.col("loc")), F.col("loc"), F.col("canonical_keys")
    body = F.col("outcome").isin("usable_body", "partial")
    same = (F.size(keys) == 1) & F.array_contains(keys, F.col("loc_key"))
    other = F.array_join(F.filter(keys, lambda k: k != F.col("loc_key")), " ")
    return hits(
        rows,
        (body & (F.size(keys) > 0) & ~same, finding("PAGE_CANONICAL_MISMATCH", ref, F.concat(loc, F.lit(" names another canonical: "), other), excerpt=F.array_join("canonicals", " "))),
        ((F.col("outcome") == "usable_body") & F.col("is_html") & (F.size(keys) == 0), finding("PAGE_CANONICAL_MISSING", ref, F.concat(loc, F.lit(" names no canonical.")))),
    )


def noindex_fold(pages: DataFrame, engine: str | None = None) -> DataFrame:
    """What the directives amount to: meta_no, header_no, explicit_index, path and effective.

    Directives for all crawlers count, and those for the engine's own. google and bing: any noindex wins; yandex: an explicit index
    or all overrides it; without an engine there is no verdict.
    """
    scopes = ["*", *CRAWLERS.get(engine or "", ())]
    own = F.filter("directives", lambda d: d["scope"].isin(scopes))
    has = lambda channel, words: F.exists(own, lambda d: (d["channel"] == channel) & F.arrays_overlap(d["tokens"], F.array(*map(F.lit, words))))
    out = pages.withColumn("meta_no", has("meta", ("noindex", "none"))).withColumn("header_no", has("header", ("noindex", "none")))
    out = out.withColumn("explicit_index", has("meta", ("index", "all")) | has("header", ("index", "all")))
    any_no = F.col("meta_no") | F.col("header_no")
    path = F.when(~any_no, "none").when(F.col("explicit_index"), "conflict").when(F.col("meta_no") & F.col("header_no"), "cross_channel").otherwise("single_channel")
    effective = F.lit(None).cast("boolean") if engine is None else any_no & ~F.col("explicit_index") if engine == "yandex" else any_no
    return out.withColumn("path", path).withColumn("effective", effective)


def noindex_findings(pages: DataFrame, ruleset: Ruleset | None = None) -> DataFrame:
    engine = ruleset.engine if ruleset else None
    rows = noindex_fold(pages.where(F.col("outcome").isin("usable_body", "partial")), engine)
    ref = page_ref(F.col("base"), F.col("loc"))
    verdict = F.when(F.col("effective").isNull(), "").when(F.col("effective"), F.lit(f"; {engine} leaves it out of the index")).otherwise(F.lit(f"; {engine} still indexes it"))
    text = lambda where: F.concat(F.col("loc"), F.lit(f" says noindex in its {where}"), verdict, F.lit("."))
    return hits(
        rows,
        (F.col("meta_no"), finding("PAGE_META_ROBOTS_NOINDEX", ref, text("robots meta element"), excerpt=F.col("path"))),
        (F.col("header_no"), finding("PAGE_XROBOTSTAG_NOINDEX", ref, text("X-Robots-Tag header"), excerpt=F.col("path"))),
    )


def attach_trap(findings: DataFrame, decisions: DataFrame, ruleset: Ruleset | None) -> DataFrame:
    """A hint on noindex findings of URLs that robots.txt disallows, under google and bing: the directive is never read.

    ``decisions``: loc, decision.
    """
    if ruleset is None or ruleset.engine not in ("google", "bing"):
        return findings
    blocked = decisions.where("decision = 'disallow'").select(F.col("loc").alias("__loc")).distinct()
    text = F.lit("robots.txt keeps crawlers from this page, so the noindex is never read and the URL can stay in the index. Allow crawling, or drop the noindex.")
    loc = F.regexp_extract("subject_ref", "#page-url:(.*)$", 1)
    out = findings.join(blocked, loc == F.col("__loc"), "left")
    trapped = F.col("__loc").isNotNull() & F.col("code").isin("PAGE_META_ROBOTS_NOINDEX", "PAGE_XROBOTSTAG_NOINDEX")
    return out.withColumn("remediation_hint", F.when(trapped, text).otherwise(F.col("remediation_hint"))).select(*findings.columns)


def declared_alternates(entries: DataFrame) -> DataFrame:
    """(loc, declared): the sitemap's alternates of each loc as sorted 'token<tab>key'."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for loc, links in zip(b.column("loc").to_pylist(), b.column("alternates").to_pylist(), strict=True):
                own = [(a["hreflang"], a["href"]) for a in links or [] if a["href"] is not None and a["hreflang"] is not None and (a["rel"] is None or a["rel"].strip().lower() == "alternate")]
                out.append(H.alternate_keys(own, loc))
            yield pa.RecordBatch.from_arrays([b.column("loc"), pa.array(out, pa.list_(pa.string()))], ["loc", "declared"])

    return entries.where((F.size("alternates") > 0) & F.col("loc").isNotNull()).select("loc", "alternates").mapInArrow(run, "loc string, declared array<string>")


def page_hreflang_findings(pages: DataFrame, declared: DataFrame) -> DataFrame:
    """Both the page and the sitemap declare alternates, and the sets differ."""
    rows = pages.where("outcome = 'usable_body' and size(alternates) > 0").join(declared.where("size(declared) > 0").dropDuplicates(["loc"]), "loc")
    counts = F.concat(F.lit("page "), F.size("alternates").cast("string"), F.lit(", sitemap "), F.size("declared").cast("string"))
    return hits(rows, (F.array_sort("alternates") != F.array_sort("declared"), finding("PAGE_HREFLANG_MISMATCH", page_ref(F.col("base"), F.col("loc")), F.concat(F.col("loc"), F.lit(" declares other alternates than the sitemap.")), excerpt=counts)))


def within_budget(selected: DataFrame, artifacts: DataFrame, budget: PageBudget) -> DataFrame:
    """``artifacts`` (a loc each) in the order of selection as far as the budget reaches; later ones are skipped, without a body. ``cap``
    names the limit that is used up before a page's turn: requests, bytes or seconds (which the fetch itself has seen). At most
    ``max_pages`` rows, so that one running sum will do."""
    before = Window.orderBy(F.sha2("loc_key", 256), "loc_key").rowsBetween(Window.unboundedPreceding, -1)
    tried = F.col("outcome") != "skipped"
    used = lambda x: F.coalesce(F.sum(F.when(tried, x)).over(before), F.lit(0))
    rows = artifacts.join(selected.select("loc", "loc_key"), "loc")
    rows = rows.withColumn("__requests", used(1 + F.size(F.coalesce("hops", F.array().cast(_HOPS))))).withColumn("__bytes", used(F.coalesce(F.octet_length("body"), F.lit(0))))
    cap = F.when(F.col("__requests") >= budget.max_requests, "max_requests").when(F.col("__bytes") >= budget.max_bytes, "max_bytes").when(~tried, "max_seconds")
    rows = rows.withColumn("cap", cap).withColumn("outcome", F.when(F.col("cap").isNotNull(), "skipped").otherwise(F.col("outcome")))
    return rows.withColumn("body", F.when(F.col("cap").isNull(), F.col("body"))).drop("__requests", "__bytes", "loc_key")


def coverage(selected: DataFrame, artifacts: DataFrame, eligible: DataFrame | None = None, *, mode: str = "sample", elapsed: float | None = None) -> DataFrame:
    """One row of tallies: how far the inspection came. ``eligible``: loc, loc_key of all that could have been selected. ``caps_hit`` names the
    budget that ended the run, of which the first in the order of selection counts."""
    n = lambda cond: F.coalesce(F.sum(cond.cast("int")), F.lit(0)).cast("int")
    out = F.col("outcome")
    cap = F.col("cap") if "cap" in artifacts.columns else F.lit(None).cast("string")
    got = artifacts.agg(
        n(out != "skipped").alias("attempted"), n(out == "usable_body").alias("completed"), n(out == "partial").alias("partial"),
        n(~out.isin("usable_body", "partial", "skipped")).alias("failed"), n(out == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(out != "skipped", 1 + F.size(F.coalesce("hops", F.array().cast(_HOPS))))), F.lit(0)).cast("int").alias("requests"),
        F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("bytes"), F.sort_array(F.collect_set(cap)).alias("caps_hit"),
    )
    known = (selected if eligible is None else eligible).agg(F.count("*").cast("int").alias("eligible"), F.count_distinct("loc_key").cast("int").alias("deduplicated"))
    rows = known.crossJoin(selected.agg(F.count("*").cast("int").alias("selected"))).crossJoin(got)
    return rows.withColumns({"elapsed": F.lit(elapsed).cast("double"), "mode": F.lit(mode), "partial_run": F.size("caps_hit") > 0})
