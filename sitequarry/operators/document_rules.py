"""Rules of whole documents: counts, sizes and lastmod statistics, one aggregation of the entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..limits import ProtocolLimits
from ..rulesets import Ruleset, format_support
from .findings import finding, hits


def document_findings(entries: DataFrame, documents: DataFrame | None = None, limits: ProtocolLimits = ProtocolLimits()) -> DataFrame:
    """``documents``: doc_id, base, byte_size (uncompressed; null if unknown), fetched_at (null: unknown)."""
    stats = entries.groupBy("doc_id", "base").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("news"), F.lit(0))).alias("news"))
    base = F.col("base")
    found = hits(
        stats,
        (F.col("n") > limits.max_url_count, finding("PROTOCOL_URL_COUNT_EXCEEDED", base, F.concat(F.col("n").cast("string"), F.lit(f" URLs; {limits.max_url_count} are allowed.")))),
        (F.col("news") > limits.max_news_per_file, finding("PROTOCOL_NEWS_COUNT_EXCEEDED", base, F.concat(F.col("news").cast("string"), F.lit(f" news elements; {limits.max_news_per_file} are allowed.")))),
    )
    found = found.unionByName(identical_lastmod(entries, limits))
    if documents is not None:
        sized = stats.join(documents.select("doc_id", "byte_size", "fetched_at"), "doc_id")
        found = found.unionByName(
            hits(sized, (F.col("byte_size") > limits.max_uncompressed_bytes, finding("PROTOCOL_SIZE_EXCEEDED", base, F.concat(F.col("byte_size").cast("string"), F.lit(f" bytes; {limits.max_uncompressed_bytes} are allowed.")))))
        ).unionByName(generated_lastmod(entries, documents, limits))
    return found


def identical_lastmod(entries: DataFrame, limits: ProtocolLimits = ProtocolLimits()) -> DataFrame:
    """The commonest lastmod's share of the dated entries, two at least. Counting in two steps keeps hot values cheap."""
    dated = entries.withColumn("t", V.parse_lastmod(F.col("lastmod"))).where("t is not null")
    modal = dated.groupBy("doc_id", "base", "t").count().groupBy("doc_id", "base").agg(F.max("count").alias("most"), F.sum("count").alias("n"), F.max_by("t", F.struct("count", "t")).alias("t"))
    return hits(
        modal,
        (
            (F.col("n") >= 2) & (F.col("most") / F.col("n") >= limits.lastmod_identical_ratio),
            finding("PROTOCOL_LASTMOD_ALL_IDENTICAL", F.col("base"), F.concat(F.col("most").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" dated entries have the same lastmod.")), excerpt=F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ),
    )


def generated_lastmod(entries: DataFrame, documents: DataFrame, limits: ProtocolLimits = ProtocolLimits()) -> DataFrame:
    """Every dated entry within the tolerance of the fetch: a generator's clock. Needs ``fetched_at``."""
    dated = entries.withColumn("t", V.parse_lastmod(F.col("lastmod"))).where("t is not null").join(documents.where("fetched_at is not null").select("doc_id", "fetched_at"), "doc_id")
    near = F.abs(F.unix_micros("t") - F.unix_micros("fetched_at")) <= int(limits.lastmod_generated_tolerance * 1_000_000)
    stats = dated.groupBy("doc_id", "base").agg(F.avg(near.cast("int")).alias("share"), F.count("*").alias("n"))
    return hits(
        stats,
        ((F.col("n") >= 2) & (F.col("share") >= limits.lastmod_identical_ratio), finding("PROTOCOL_LASTMOD_LOOKS_GENERATED", F.col("base"), F.concat(F.lit("All "), F.col("n").cast("string"), F.lit(" lastmods lie close to the time of the fetch.")))),
    )


def classification_findings(documents: DataFrame, ruleset: Ruleset | None = None) -> DataFrame:
    """``documents``: base, format, root, variant (of a feed)."""
    rules = [
        (F.col("format") == "html", finding("UNSUPPORTED_HTML_MASQUERADE", F.col("base"), F.lit("An HTML page stands where a sitemap should."))),
        (F.col("format") == "xml", finding("UNSUPPORTED_ROOT", F.col("base"), F.concat(F.lit("The root element is "), F.coalesce(F.col("root"), F.lit("unknown")), F.lit(", not urlset or sitemapindex.")), excerpt=F.col("root"))),
    ]
    if ruleset and ruleset.engine:
        refused = [v for v in ("rss2.0", "atom1.0", "atom0.3") if format_support(v, ruleset.engine) == "unsupported"]
        if refused:
            rules.append((F.col("variant").isin(*refused), finding("ENGINE_UNSUPPORTED_SITEMAP_FORMAT", F.col("base"), F.concat(F.lit(f"{ruleset.name} does not take "), F.col("variant"), F.lit(".")))))
    return hits(documents, *rules)


def encoding_findings(documents: DataFrame) -> DataFrame:
    """``documents``: base, bom, declared, http_charset (labels or null). Only where these are known."""
    bom, declared, http = (V.norm_encoding(F.col(c)) for c in ("bom", "declared", "http_charset"))
    text = lambda a, b: F.concat(F.col(a), F.lit(" against "), F.col(b))
    return hits(
        documents,
        (bom != declared, finding("ENCODING_BOM_DECLARATION_CONFLICT", F.col("base"), F.concat(F.lit("Byte order mark and declaration differ: "), text("bom", "declared")))),
        (bom != http, finding("ENCODING_CONFLICT", F.col("base"), F.concat(F.lit("Byte order mark and HTTP charset differ: "), text("bom", "http_charset")))),
        (bom.isNull() & (declared != http), finding("ENCODING_CONFLICT", F.col("base"), F.concat(F.lit("Declaration and HTTP charset differ: "), text("declared", "http_charset")))),
    )
