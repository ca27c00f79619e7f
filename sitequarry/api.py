"""The public interface: read, validate, tree, probe, audit, diff, report.

Sources are URLs, paths or (name, bytes) pairs. Nothing is fetched unless a ``transport`` is given (``sources.http.urllib_transport``
for the network).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import limits as L
from . import schema
from .functions.urls import absoluteness, authority, canonical, loc_key, with_url
from .operators import diff as DF
from .operators import entry_rules as E
from .operators import index as IX
from .operators import pages as P
from .operators import report as R
from .operators import robots as RB
from .operators.findings import assemble, order, union
from .plans import discovery
from .plans import expand as X
from .plans import validate as V
from .rulesets import Context, Ruleset
from .sources import documents as S
from .sources import http as H
from .sources import raw
from .storage import Workspace

Source = str | tuple[str, bytes]


class SourceFailed(Exception):
    """A single source failed and errors were to be raised."""


# == inputs


def is_local(source: str) -> bool:
    """A path: one with a leading slash, dot, tilde or drive, or a file URL; 'host.tld/...' is taken for a URL."""
    s = source.strip()
    return s.startswith(("/", ".", "~", "file:")) or (len(s) > 2 and s[1] == ":" and s[2] in "/\\") or ("://" not in s and "/" not in s and s.lower().endswith((".xml", ".txt", ".gz", ".tgz")))


def source_records(spark: SparkSession, sources: Iterable[str], *, as_root: bool = False, limit: int = L.MAX_SUBMITTED) -> DataFrame:
    """``schema.SOURCE_RECORD``: https assumed where there is no scheme, canonical, the first of an identity only; more than the limit
    raises. ``as_root`` keeps the origin alone."""
    items = [sources] if isinstance(sources, str) else list(sources)
    if not items or not all(isinstance(s, str) and s.strip() for s in items):
        raise ValueError("sources must be texts that are not blank, one at least")
    provenance = "submitted-directly" if isinstance(sources, str) else "submitted-list"
    rows: dict[str, tuple] = {}
    for s in items:
        if is_local(s):
            rows.setdefault(f"file:{s}", (s, s, None, None, None, s, None, None, True, False, provenance, f"file:{s}"))
            continue
        inferred = "://" not in s
        parts = canonical("https://" + s.strip() if inferred else s.strip())
        if not parts or parts[0] not in ("http", "https"):
            raise ValueError(f"{s!r} is no http(s) URL")
        scheme, host, port, path, query, fragment, _ = parts
        if as_root:
            path, query, fragment = "/", None, None
        own = (scheme, port) in (("http", 80), ("https", 443))
        url = f"{scheme}://{host}{'' if port is None or own else f':{port}'}{path}{'?' + query if query else ''}"
        rows.setdefault(loc_key(url), (s, url, scheme, host, port, path, query, fragment, False, inferred, provenance, loc_key(url)))
    if len(rows) > limit:
        raise ValueError(f"{len(rows)} sources; {limit} are taken at once")
    return spark.createDataFrame(list(rows.values()), schema.SOURCE_RECORD)


def load(spark: SparkSession, sources: Source | Iterable[Source], *, transport: H.Transport | None = None, policy: H.Policy = H.Policy(), limits: L.FetchLimits = L.FetchLimits()) -> DataFrame:
    """Sources as documents (``schema.DOCUMENT``)."""
    items = [sources] if isinstance(sources, (str, tuple)) else list(sources)
    given = [s for s in items if isinstance(s, tuple)]
    named = [s for s in items if isinstance(s, str)]
    parts = [S.from_bytes(spark, given)] if given else []
    if named:
        records = source_records(spark, named[0] if len(named) == 1 else named).collect()
        local, remote = [r.original_input for r in records if r.is_local_file], [(r.normalized_url, r.scheme_inferred) for r in records if not r.is_local_file]
        if local:
            parts.append(S.read_files(spark, local))
        if remote:
            if transport is None:
                raise ValueError("URLs are fetched only with a transport")
            parts.append(H.fetch_documents(spark.createDataFrame(remote, "url string, scheme_inferred boolean"), transport, policy, limits))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _fetcher(transport: H.Transport | None, policy: H.Policy, limits: L.FetchLimits) -> X.Fetcher:
    if transport is None:
        return lambda urls: urls.sparkSession.createDataFrame([], schema.DOCUMENT)
    return lambda urls: H.fetch_documents(urls, transport, policy, limits)


# == the audit: one fetch, one expansion, five relations


@dataclass
class Audit:
    urls: DataFrame
    findings: DataFrame
    sources: DataFrame
    problems: DataFrame
    tree: DataFrame
    parsed: DataFrame | None = field(default=None, repr=False)
    expansion: X.Expansion | None = field(default=None, repr=False)
    entries: DataFrame | None = field(default=None, repr=False)

    def summary(self) -> DataFrame:
        return R.severity_counts(self.findings).crossJoin(self.urls.agg(F.count("*").alias("urls"))).crossJoin(self.sources.agg(F.count("*").alias("sources")))


def audit(
    spark: SparkSession, sources: Source | Iterable[Source], *, mode: str = "strict", ruleset: Ruleset | None = None, transport: H.Transport | None = None, policy: H.Policy = H.Policy(),
    limits: L.FetchLimits = L.FetchLimits(), index_limits: L.IndexLimits = L.IndexLimits(), protocol_limits: L.ProtocolLimits = L.ProtocolLimits(), on_urls: Callable[[DataFrame, str], None] | None = None,
) -> Audit:
    """Reads, expands and validates. Failures of sources are findings and problems, never raised.

    ``on_urls(rows, source)`` is called once a sitemap with its typed rows, in order; if it raises, the audit ends with the
    sitemap's name.
    """
    ws = Workspace(spark, "audit")
    parsed = ws.table(S.with_base(S.parse(load(spark, sources, transport=transport, policy=policy, limits=limits))), "parsed")
    ex = X.expand(spark, parsed, _fetcher(transport, policy, limits), index_limits)
    below = ex.entries()
    own = S.entries(parsed).withColumn("root", F.col("doc_id")).withColumn("ord", F.lit(0))
    entries = ws.table(own.unionByName(below.select(*own.columns)), "entries")
    kinds = {r.kind for r in parsed.select("kind").distinct().collect()}
    parts = V.findings_parts(parsed, ruleset, protocol_limits, kinds=kinds)
    if ex.leaves.head(1):
        keyed = E.keyed(entries.where("ord > 0").dropDuplicates(["doc_id", "entry_ix"]))
        sizes = ex.parsed.select("doc_id", F.when(~F.col("gzip"), F.col("byte_size")).alias("byte_size"), F.lit(None).cast("timestamp").alias("fetched_at"))
        parts += V.protocol_parts(keyed, sizes, ruleset, protocol_limits)
    if "index" in kinds:
        parts += [ex.findings(), IX.child_scope_findings(S.children(parsed), ruleset)]
    all_parsed = parsed.unionByName(S.with_base(ex.parsed).select(*parsed.columns)) if ex.parsed.columns else parsed
    urls = S.urls(entries.orderBy("root", "ord", "entry_ix"))
    if on_urls is not None:
        per = ws.partitioned(entries.withColumn("sitemap", F.col("source_sitemap")), "by-sitemap", "sitemap")  # each call reads its own folder
        for r in entries.select("root", "ord", "source_sitemap").distinct().orderBy("root", "ord", "source_sitemap").collect():
            try:
                on_urls(S.urls(per.where(F.col("sitemap") == r.source_sitemap).drop("sitemap").orderBy("entry_ix")), r.source_sitemap)
            except Exception as e:
                raise RuntimeError(f"on_urls failed for {r.source_sitemap}") from e
    roots = parsed.select(
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_sitemap"), F.coalesce("final_url", "requested_url").alias("sitemap_url"),
        F.when(F.col("kind") == "index", F.size("children")).otherwise(F.size("entries")).alias("page_count"), "gzip", F.when(F.col("error_class").isNull(), "accepted").otherwise("rejected").alias("status"),
        "error_class", F.lit("submitted-directly").alias("provenance"),
    ).withColumnRenamed("error_class", "reason")
    found = order(ws.table(assemble(spark, parts, mode, ruleset, ordered=False), "findings"))  # read by reports and comparisons again and again
    return Audit(
        urls, found, S.sources(all_parsed), S.problems(all_parsed).unionByName(ex.problems()), roots.unionByName(ex.tree), parsed, ex, entries
    )


def read(spark: SparkSession, sources: Source | Iterable[Source], *, errors: str = "raise", **how) -> Audit:
    """Typed rows of all sources. A single failing source raises, unless ``errors='capture'``; in a list failures are problems."""
    out = audit(spark, sources, **how)
    if errors == "raise" and isinstance(sources, (str, tuple)):
        bad = out.parsed.where("error_class is not null").select("requested_url", F.coalesce("error", "error_class").alias("why")).head(1)
        if bad:
            raise SourceFailed(f"{bad[0].requested_url}: {bad[0].why}")
    return out


@dataclass
class PageInspection:
    transport: H.Transport
    sample: int | None = 50
    policy: H.Policy = H.Policy(user_agent="sitequarry-pages")
    budget: L.PageBudget = L.PageBudget()


@dataclass
class Validation:
    findings: DataFrame
    coverage: DataFrame | None = None


def validate(
    spark: SparkSession, sources: Source | Iterable[Source], *, mode: str = "strict", ruleset: str | None = None, context: Context = Context(), robots_files: DataFrame | None = None, robots_agent: str = "*",
    robots_states: DataFrame | None = None, check_robots: bool = False, inspect: PageInspection | None = None, **how,
) -> Validation:
    """Findings of all sources, opt-in with robots.txt and pages. ``check_robots`` fetches each origin's robots.txt, once, through the
    transport; ``robots_files`` (origin, text) and ``robots_states`` (origin, state) are for those at hand."""
    rules = Ruleset(ruleset, context) if ruleset else None
    done = audit(spark, sources, mode=mode, ruleset=rules, **how)
    parts = [done.findings]
    subjects = done.entries.select("base", "loc").where("loc is not null")
    decisions = None
    sites = done.parsed.where("final_url is not null").select("base", F.col("final_url").alias("sitemap_url"))
    locs = subjects.select("loc").unionByName(sites.select(F.col("sitemap_url").alias("loc")))
    if check_robots and robots_files is None:
        if how.get("transport") is None:
            raise ValueError("robots.txt is fetched only with a transport")
        origins = with_url(locs.where(absoluteness(F.col("loc")) == "http(s)")).where("url.host is not null").select(F.concat(authority(F.col("url")), F.lit("/robots.txt")).alias("url")).distinct()
        fetched = _fetcher(how["transport"], how.get("policy", H.Policy()), how.get("limits", L.FetchLimits()))(origins)
        robots_files, robots_states = RB.fetched_files(Workspace(spark, "robots").table(fetched, "files"))
    if robots_files is not None:
        decisions = RB.decide(locs, RB.rules(robots_files), robots_states, robots_agent)
        parts += [RB.robots_findings(subjects, decisions), RB.robots_sitemap_findings(sites, decisions)]
    coverage = None
    if inspect is not None:
        ws = Workspace(spark, "pages")
        budget, began = inspect.budget, time.time()
        most = int(min(budget.max_pages, inspect.sample or budget.max_pages))
        selected = ws.table(P.select_pages(subjects, most), "selected")
        artifacts = ws.table(H.fetch_pages(selected, inspect.transport, inspect.policy, cap=int(budget.page_body_cap), deadline=began + budget.max_seconds), "artifacts")
        artifacts, elapsed = ws.table(P.within_budget(selected, artifacts, budget), "within"), time.time() - began
        keyed = with_url(subjects.distinct()).select("base", F.col("loc").alias("advertised"), "loc_key")
        shown = artifacts.drop("cap").join(selected, "loc").drop("loc").join(keyed, "loc_key").withColumnRenamed("advertised", "loc")
        facts = P.facts(shown.drop("loc_key"))
        noindex = P.noindex_findings(facts, rules)
        if decisions is not None:
            noindex = P.attach_trap(noindex, decisions, rules)
        parts += [P.transport_findings(shown.drop("loc_key")), P.canonical_findings(facts), noindex, P.page_hreflang_findings(facts, P.declared_alternates(done.entries))]
        eligible = with_url(subjects.where(absoluteness(F.col("loc")) == "http(s)").select("loc")).where("url.host is not null").select("loc", "loc_key")
        coverage = P.coverage(selected, artifacts, eligible, mode="sample" if inspect.sample else "full", elapsed=elapsed)
    if len(parts) == 1:
        return Validation(done.findings)
    return Validation(assemble(spark, [union(parts)], mode, rules), coverage)


# == discovery


def tree(
    spark: SparkSession, root: str, *, transport: H.Transport, policy: H.Policy = H.Policy(), limits: L.FetchLimits = L.FetchLimits(), index_limits: L.IndexLimits = L.IndexLimits(),
    discovery_limits: L.DiscoveryLimits = L.DiscoveryLimits(), use_robots: bool = True, use_known_paths: bool = True,
) -> DataFrame:
    """``schema.TREE`` of a site: what robots.txt names and the well-known paths hold, indexes expanded."""
    ws = Workspace(spark, "tree")
    origin = source_records(spark, root, as_root=True).first().normalized_url.rstrip("/")
    roots = spark.createDataFrame([(origin,)], "root string")
    named = None
    if use_robots:
        got = H.fetch(f"{origin}/robots.txt", transport, policy, limits)
        text = (got.body or b"").decode("utf-8", "replace") if got.outcome == "usable_body" else ""
        named = RB.sitemap_directives(spark.createDataFrame([(origin, text)], "origin string, text string")).withColumnRenamed("origin", "root")
    found = ws.table(discovery.candidates(roots, named, discovery_limits, known_paths=use_known_paths), "candidates")
    parsed = ws.table(S.parse(_fetcher(transport, policy, limits)(found.select(F.col("candidate_url").alias("url")))), "parsed")
    seen = parsed.select(F.col("requested_url").alias("candidate_url"), F.col("status").alias("http_status"), F.when(F.col("status").between(200, 299), None).otherwise(F.coalesce("error_class", F.lit("fetch"))).alias("error_class"), "final_url", "gzip", F.col("kind").alias("content"), F.size("entries").alias("n"), F.size("children").alias("c"))
    judged = discovery.classify(found, seen)
    top = judged.orderBy("ord").select(
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_sitemap"), F.coalesce("final_url", "candidate_url").alias("sitemap_url"),
        F.when((F.col("status") == "accepted") & F.col("content").isin("urlset", "text", "feed"), F.col("n")).when((F.col("status") == "accepted") & (F.col("content") == "index"), F.col("c")).cast("int").alias("page_count"),
        F.when(F.col("status") == "accepted", F.col("gzip")).alias("gzip"), "status", "reason", "provenance",
    )
    return top.unionByName(X.expand(spark, parsed.where("status between 200 and 299"), _fetcher(transport, policy, limits), index_limits).tree)


def tree_from_bytes(spark: SparkSession, data: bytes, source_url: str, *, transport: H.Transport | None = None, **how) -> DataFrame:
    """``schema.TREE`` of a sitemap that is at hand."""
    return audit(spark, (source_url, data), transport=transport, **how).tree


def probe_bytes(data: bytes, url: str = "", status: int | None = 200, content_type: str | None = None) -> dict:
    """What one source is: content_type, detected_type, xml_root, is_compressed, child_count, a sample of its text, problems and what to do next."""
    out = {"url": url, "final_url": url, "status_code": status, "xml_root": None, "is_compressed": data[:2] == b"\x1f\x8b", "child_count": None, "problems": None}
    p = S.parse_bytes(data)
    try:
        body = raw.gunzip(data) if out["is_compressed"] else data
    except raw.SourceError:
        body = b""
    text = body[:4096].decode("utf-8", "replace")
    out["xml_root"] = p.get("root")
    if status == 404 or status == 410:
        kind = "not_found"
    elif status is None or not 200 <= status <= 299:
        kind = "fetch_error"
    elif p["format"] == "html":
        kind = "html"
    elif p["format"] == "text" and (url.split("?", 1)[0].endswith("/robots.txt") or any(line.lower().startswith("user-agent:") for line in text.splitlines())):
        kind, out["child_count"] = "robots_txt", len([r for r in text.lower().splitlines() if r.startswith("sitemap:")])
    elif p["kind"] in ("urlset", "text", "archive"):
        kind, out["child_count"] = "sitemap", len(p["entries"])
    elif p["kind"] == "index":
        kind, out["child_count"] = "sitemap_index", len(p["children"])
    elif p["format"] == "feed" and p["kind"] == "feed":
        kind, out["child_count"] = "feed", len(p["entries"])
    elif p["kind"] == "other":
        kind = "xml_other"
    else:
        kind, out["problems"] = "parse_error", p.get("error")
    following = {
        "sitemap": "read", "sitemap_index": "read, to expand the children", "feed": "read", "robots_txt": "tree, to follow its sitemaps", "html": "tree, on the site's root", "xml_other": "look at the document",
        "not_found": "tree, on the site's root", "fetch_error": "try again later", "parse_error": "validate",
    }
    return out | {"content_type": content_type, "detected_type": kind, "sample": text[:500], "suggested_next": following[kind]}


def probe(url: str, *, transport: H.Transport, policy: H.Policy = H.Policy(), limits: L.FetchLimits = L.FetchLimits()) -> dict:
    got = H.fetch(url, transport, policy, limits)
    out = probe_bytes(got.body or b"", got.final, got.status, next((v[0] for k, v in got.headers.items() if k.lower() == "content-type" and v), None))
    return out | {"url": url, "final_url": got.final, "problems": out["problems"] or (None if got.outcome in ("usable_body", "http_status") else got.outcome)}


# == comparing


@dataclass
class AuditDiff:
    components: dict[str, dict[str, DataFrame]]

    def counts(self) -> DataFrame:
        return DF.counts(self.components)

    def unchanged(self) -> bool:
        return not self.counts().agg(F.sum("n")).first()[0]


def diff(old: Audit, new: Audit) -> AuditDiff:
    """What was added, removed and changed, for each component."""
    return AuditDiff({name: DF.diff(getattr(old, name), getattr(new, name), key, ignore) for name, (key, ignore) in DF.SPECS.items()})


__all__ = [
    "Audit", "AuditDiff", "PageInspection", "SourceFailed", "Validation", "audit", "diff", "is_local", "load", "probe", "probe_bytes", "read", "source_records", "tree",
    "tree_from_bytes", "validate",
]
