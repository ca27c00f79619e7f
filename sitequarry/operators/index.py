"""Index children: keep-first, caps, scope and running budgets, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..limits import IndexLimits
from ..rulesets import Ruleset
from .findings import finding, hits


def distinct_children(children: DataFrame) -> DataFrame:
    """Of each index (doc_id), the first child of every identity in catalog order, numbered anew as ``nth``.

    ``children``: doc_id, child_ix, loc and what else there is. Children without a loc are left out; one that is no URL is its own
    identity.
    """
    keyed = U.with_url(children.where("loc is not null and trim(loc) <> ''"))
    first = F.row_number().over(Window.partitionBy("doc_id", "loc_key").orderBy("child_ix"))
    kept = keyed.withColumn("__n", first).where("__n = 1").drop("__n")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("child_ix"))).drop("url")


def capped_children(children: DataFrame, limits: IndexLimits = IndexLimits()) -> DataFrame:
    return distinct_children(children).where(F.col("nth") <= limits.max_children)


def child_count_findings(children: DataFrame, limits: IndexLimits = IndexLimits()) -> DataFrame:
    """``children``: with ``base``."""
    n = distinct_children(children).groupBy("doc_id", "base").agg(F.max("nth").alias("n"))
    return hits(n, (F.col("n") > limits.max_children, finding("INDEX_CHILD_COUNT_EXCEEDED", F.col("base"), F.concat(F.col("n").cast("string"), F.lit(f" children; {limits.max_children} are followed.")))))


def child_scope_findings(children: DataFrame, ruleset: Ruleset | None) -> DataFrame:
    """Children outside the index's site; under google also those not at or below its directory. Engine rulesets only."""
    rows = U.with_url(U.with_url(children, "sitemap_url", "self", "self_key"))
    same = U.authority(F.col("url")) == U.authority(F.col("self"))
    if ruleset and ruleset.name == "google":
        same = same & F.col("url.path").startswith(U.directory(F.col("self.path")))
    out = F.lit(bool(ruleset and ruleset.engine)) & F.col("url.host").isNotNull() & F.col("self.host").isNotNull() & ~F.coalesce(same, F.lit(False))
    ref = F.concat(F.col("base"), F.lit("#index-child:"), F.col("loc"))
    return hits(rows, (out, finding("INDEX_CHILD_OUT_OF_SCOPE", ref, F.concat(F.col("loc"), F.lit(" is outside the index's site.")), excerpt=F.col("loc"))))


def within_budget(leaves: DataFrame, limits: IndexLimits, by: list[str] | None = None, order: str = "ord") -> DataFrame:
    """``leaves`` (with ``n_urls`` and the order) with ``sitemaps`` and ``urls`` so far and ``kept``.

    A leaf that would take the sum over a budget is dropped whole, and so is everything after it.
    """
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = leaves.withColumn("sitemaps", F.count("*").over(w)).withColumn("urls", F.sum("n_urls").over(w))
    over = (F.col("sitemaps") > F.lit(float(limits.max_total_sitemaps))) | (F.col("urls") > F.lit(float(limits.max_total_urls)))
    return out.withColumn("kept", F.max(over.cast("int")).over(w) == 0)
