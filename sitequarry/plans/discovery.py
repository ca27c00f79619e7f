"""Discovery candidates: roots x catalog paths, and what robots.txt names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..limits import DiscoveryLimits

GENERIC = tuple(f"/{p}" for p in "sitemap.xml sitemap_index.xml sitemap-index.xml sitemap.xml.gz sitemap.txt sitemap/index.xml sitemaps.xml news-sitemap.xml sitemap-news.xml".split())
CMS = (("/wp-sitemap.xml", "wordpress"), ("/sitemap.xml", "shopify"))
#: (path, kind, source), in order.
CATALOG = [(p, "generic", "generic") for p in GENERIC] + [(p, "cms", s) for p, s in CMS]


def candidates(roots: DataFrame, robots: DataFrame | None = None, limits: DiscoveryLimits = DiscoveryLimits(), *, known_paths: bool = True) -> DataFrame:
    """(root, candidate_url, catalog_path, kind, source, provenance, ord) of each root (an origin): robots.txt's sitemaps first, then
    the catalog; the first of an identity stays, and as many as the limit allows. ``robots``: root, line_no, sitemap."""
    catalog = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("catalog_path"), F.lit(k).alias("kind"), F.lit(s).alias("source")) for i, (p, k, s) in enumerate(CATALOG)])
    each = roots.select("root", F.explode(catalog).alias("c")).where(F.lit(known_paths))
    rows = each.select(
        "root", F.concat("root", "c.catalog_path").alias("candidate_url"), "c.catalog_path", "c.kind", "c.source", F.lit("guessed-path").alias("provenance"), (F.col("c.i") + 1_000_000).alias("o")
    )
    if robots is not None:
        rows = rows.unionByName(
            robots.select("root", F.col("sitemap").alias("candidate_url"), F.lit(None).cast("string").alias("catalog_path"), F.lit("robots").alias("kind"), F.lit("robots").alias("source"), F.lit("robots").alias("provenance"), F.col("line_no").alias("o"))
        )
    keyed = U.with_url(rows, "candidate_url")
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("root", "loc_key").orderBy("o"))).where("__n = 1")
    out = first.withColumn("ord", F.row_number().over(Window.partitionBy("root").orderBy("o"))).where(F.col("ord") <= limits.max_candidates)
    return out.select("root", "ord", "provenance", "source", "kind", "catalog_path", "candidate_url")


def classify(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    """Adds status, reason, http_status and final_url. ``fetched``: candidate_url, http_status, error_class, final_url."""
    out = candidates.join(fetched, "candidate_url", "left")
    fine = F.col("error_class").isNull() & F.col("http_status").between(200, 299)
    why = F.when(F.col("provenance") == "robots", "robots").when(F.col("kind") == "cms", F.concat(F.lit("catalog-"), "source")).otherwise("catalog-generic")
    bad = F.when(F.col("http_status") == 404, "not-found").when(F.col("http_status").isNotNull(), F.concat(F.lit("http-"), F.col("http_status").cast("string"))).otherwise("unreachable")
    return out.withColumn("status", F.when(F.coalesce(fine, F.lit(False)), "accepted").otherwise("rejected")).withColumn("reason", F.when(F.col("status") == "accepted", why).otherwise(bad)).drop("error_class")
