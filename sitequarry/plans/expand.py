"""Index expansion: fetch level by level, then replay the traversal.

Documents are fetched and parsed in parallel, a level at a time, each identity once. Which child counts as visited, too deep or
over budget depends on depth-first catalog order; that is decided afterwards on the driver, from a row a sitemap, which for an
index holds its children up to the limit. Entries never leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import absoluteness, base_ref, loc_key, with_url
from ..limits import IndexLimits
from ..operators.findings import finding, hits
from ..operators.index import distinct_children
from ..schema import TREE
from ..sources import documents as S
from ..storage import Workspace

#: (url) rows -> documents (``schema.DOCUMENT``).
Fetcher = Callable[[DataFrame], DataFrame]
_EVENTS = "root string, base string, code string, category string, subject string, message string"
_LEAVES = "root string, requested_key string, ord int"


@dataclass
class Expansion:
    parsed: DataFrame  # what was fetched below the roots, parsed
    leaves: DataFrame  # root, requested_key, ord: the leaves that count
    tree: DataFrame  # schema.TREE
    events: DataFrame  # problems, with their finding codes (null: none)

    def entries(self) -> DataFrame:
        """Entries of the leaves that count, with ``root`` and ``ord``; the order is (ord, entry_ix)."""
        rows = with_url(S.with_base(self.parsed), "requested_url", "__u", "requested_key").drop("__u")
        return S.entries(rows.join(self.leaves.select("requested_key").distinct(), "requested_key", "left_semi")).join(
            rows.select("doc_id", "requested_key").join(self.leaves, "requested_key").select("doc_id", "root", "ord"), "doc_id"
        )

    def findings(self) -> DataFrame:
        events = self.events.where("code is not null")
        subject, text = F.col("subject"), F.col("message")
        ref = F.concat(F.col("base"), F.lit("#index-child:"), subject)
        codes = ("INDEX_CYCLE_DETECTED", "INDEX_DEPTH_EXCEEDED", "SITEMAP_INDEX_NESTED", "INDEX_CHILD_COUNT_EXCEEDED", "INDEX_TOTAL_SITEMAPS_EXCEEDED", "INDEX_TOTAL_URLS_EXCEEDED", "UNSUPPORTED_FEED")
        return hits(events, *[(F.col("code") == c, finding(c, ref, text, excerpt=subject)) for c in codes])

    def problems(self) -> DataFrame:
        return self.events.select(F.lit("warning").alias("severity"), "category", F.col("subject").alias("subject_ref"), "message")


@dataclass
class _Node:
    final: str
    kind: str
    error: str | None
    status: int | None
    n: int
    gzip: bool
    children: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class _Replay:
    """One root's depth-first traversal over what was fetched."""

    root: str
    base: str
    nodes: dict[str, _Node]
    limits: IndexLimits
    visited: set[str] = field(default_factory=set)
    sitemaps: int = 0
    urls: int = 0
    stopped: bool = False
    tree: list[tuple] = field(default_factory=list)
    events: list[tuple] = field(default_factory=list)
    leaves: list[tuple] = field(default_factory=list)

    def event(self, code: str | None, subject: str, message: str, category: str = "index-expansion") -> None:
        self.events.append((self.root, self.base, code, category, subject, message))

    def row(self, depth: int, parent: str, url: str, n: int | None = None, gzip: bool | None = None, reason: str | None = None) -> None:
        self.tree.append((depth, parent, url, n, gzip, "rejected" if reason else "accepted", reason, "index-child"))

    def node(self, parent: str, children: list[tuple[str, str]], depth: int) -> None:
        first: dict[str, str] = {}
        for url, key in children:
            first.setdefault(key, url)
        unique = list(first.items())
        if len(unique) > self.limits.max_children:
            self.event("INDEX_CHILD_COUNT_EXCEEDED", parent, f"{len(unique)} children; the first {self.limits.max_children} are followed.")
            unique = unique[: self.limits.max_children]
        for key, url in unique:
            if self.stopped:
                return
            if self.sitemaps >= self.limits.max_total_sitemaps:
                self.event("INDEX_TOTAL_SITEMAPS_EXCEEDED", parent, f"{self.sitemaps} sitemaps are fetched, as many as allowed; the rest is left out.")
                self.stopped = True
                return
            if key in self.visited:
                self.event("INDEX_CYCLE_DETECTED", url, "The sitemap was visited before and is not followed again.")
                self.row(depth + 1, parent, url, reason="cycle")
            elif depth + 1 > self.limits.max_depth:
                self.event("INDEX_DEPTH_EXCEEDED", url, f"The sitemap lies deeper than {self.limits.max_depth} levels and is not followed.")
                self.row(depth + 1, parent, url, reason="depth-exceeded")
            else:
                self.visited.add(key)
                self.child(url, key, parent, depth + 1)

    def child(self, url: str, key: str, parent: str, depth: int) -> None:
        n = self.nodes.get(key)
        if n is None or (n.error and n.status is None):
            self.event(None, url, "The sitemap could not be fetched.", "fetch")
            self.row(depth, parent, url, reason="unfetchable")
            return
        self.sitemaps += 1
        self.visited.add(loc_key(n.final) or n.final)
        if n.error == "http_error":
            self.event(None, n.final, f"The sitemap answers with status {n.status}.", "fetch")
            self.row(depth, parent, n.final, reason=f"http-{n.status}")
        elif n.error == "unsupported_feed":
            self.event("UNSUPPORTED_FEED", n.final, "The feed's dialect is not supported.", "classification")
            self.row(depth, parent, n.final, gzip=n.gzip, reason="unsupported-feed")
        elif n.error or n.kind in ("html", "other", "archive"):
            self.event(None, n.final, "The sitemap could not be parsed.", "parse")
            self.row(depth, parent, n.final, gzip=n.gzip, reason="unparseable")
        elif n.kind == "index":
            self.event("SITEMAP_INDEX_NESTED", n.final, "An index within an index; it is followed.")
            self.row(depth, parent, n.final, len(n.children), n.gzip)
            self.node(n.final, n.children, depth)
        elif self.urls + n.n > self.limits.max_total_urls:
            self.event("INDEX_TOTAL_URLS_EXCEEDED", n.final, f"{self.urls} URLs are gathered and {n.n} more would exceed the limit; the rest is left out.")
            self.stopped = True
            self.row(depth, parent, n.final, n.n, n.gzip, "url-budget")
        else:
            self.urls += n.n
            self.leaves.append((self.root, key, len(self.leaves) + 1))
            self.row(depth, parent, n.final, n.n, n.gzip)


def _children(parsed: DataFrame, ws: Workspace, name: str, limits: IndexLimits) -> DataFrame:
    """(url, key) of the children to fetch of the indexes in ``parsed``."""
    kids = S.children(S.with_base(parsed))
    kids = distinct_children(kids.where(absoluteness(F.col("loc")) == "http(s)")).where(F.col("nth") <= limits.max_children)
    return ws.table(kids.groupBy("loc_key").agg(F.min_by("loc", F.struct("doc_id", "nth")).alias("url")).select("url", "loc_key"), name)


def expand(spark: SparkSession, roots: DataFrame, fetcher: Fetcher, limits: IndexLimits = IndexLimits()) -> Expansion:
    """Expands the indexes among ``roots`` (parsed documents with a final URL). Local indexes are not expanded."""
    ws = Workspace(spark, "expand")
    roots = roots.where("kind = 'index' and final_url is not null")
    level, known = _children(roots, ws, "frontier-0", limits), None
    fetched: DataFrame | None = None
    for depth in range(1, limits.max_depth + 1):
        if known is not None:
            level = ws.table(level.join(known, "loc_key", "left_anti"), f"new-{depth}")
        if not level.head(1):
            break
        parsed = ws.table(S.parse(fetcher(level.select("url"))), f"parsed-{depth}")
        fetched = parsed if fetched is None else fetched.unionByName(parsed)
        known = level.select("loc_key") if known is None else known.unionByName(level.select("loc_key"))
        level = _children(parsed, ws, f"frontier-{depth}", limits)
    if fetched is None:
        fetched = roots.limit(0).select(*S.parse(spark.createDataFrame([], S.DOCUMENT)).columns)
    sums = fetched.select("requested_url", "final_url", "kind", "error_class", "status", F.size("entries").alias("n"), "gzip", F.when(F.col("kind") == "index", F.col("children.loc")).alias("locs"))
    pairs = lambda locs: [(u, loc_key(u) or u) for u in locs or [] if u]
    nodes = {loc_key(r.requested_url): _Node(r.final_url or r.requested_url, r.kind, r.error_class, r.status, r.n, bool(r.gzip), pairs(r.locs)) for r in sums.collect()}
    tree, events, leaves = [], [], []
    for r in roots.select("doc_id", "final_url", base_ref(F.col("final_url")).alias("base"), F.col("children.loc").alias("locs")).orderBy("doc_id").collect():
        replay = _Replay(r.doc_id, r.base, nodes, limits, {loc_key(r.final_url)})
        replay.node(r.final_url, pairs(r.locs), 0)
        tree += replay.tree
        events += replay.events
        leaves += replay.leaves
    return Expansion(fetched, spark.createDataFrame(leaves, _LEAVES), spark.createDataFrame(tree, TREE), spark.createDataFrame(events, _EVENTS))
