"""What reports show: aggregates of urls, findings and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LAYERS, SEVERITIES
from .findings import _rank


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: fatal, error, warning, info."""
    return findings.agg(*[F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0)).cast("long").alias(s) for s in SEVERITIES])


def lastmod_histogram(urls: DataFrame) -> DataFrame:
    """(month, n) of the dated URLs."""
    return urls.where("lastmod is not null").groupBy(F.date_format("lastmod", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def lastmod_coverage(urls: DataFrame) -> DataFrame:
    return urls.agg(F.count("*").alias("n"), F.count("lastmod").alias("dated"), F.round(100 * F.count("lastmod") / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"))


def folder_tree(urls: DataFrame) -> DataFrame:
    """(prefix, depth, n): URLs at or below each folder of the paths; the root is ''."""
    path = F.regexp_replace(F.regexp_replace("loc", r"^[\w+.\-]+://[^/]+", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rows = urls.where("loc is not null").select(parts.alias("p"))
    depth = F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth")
    each = rows.select("p", depth).select("depth", F.concat_ws("/", F.slice("p", 1, F.col("depth"))).alias("prefix"))
    return each.groupBy("prefix", "depth").agg(F.count("*").alias("n"))


def finding_samples(findings: DataFrame) -> DataFrame:
    """(layer, code, severity, n, sample_ref, sample_message) by layer, severity and count; the sample is the least reference."""
    found = findings.groupBy("layer", "code").agg(
        F.min_by("severity", _rank("severity", SEVERITIES)).alias("severity"),
        F.count("*").alias("n"),
        F.min(F.struct("subject_ref", "message")).alias("s"),
    )
    out = found.select("layer", "code", "severity", "n", F.col("s.subject_ref").alias("sample_ref"), F.col("s.message").alias("sample_message"))
    return out.orderBy(_rank("layer", LAYERS), _rank("severity", SEVERITIES), F.desc("n"), "code")


def source_counts(urls: DataFrame) -> DataFrame:
    """(source_sitemap, n, has_lastmod, has_priority, has_changefreq)."""
    some = lambda c: F.bool_or(F.col(c).isNotNull())
    return urls.groupBy("source_sitemap").agg(F.count("*").alias("n"), some("lastmod").alias("has_lastmod"), some("priority").alias("has_priority"), some("changefreq").alias("has_changefreq"))


def format_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("format").agg(F.count("*").alias("n"))
