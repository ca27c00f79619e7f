"""Graphs: connected components of an edge list, and the alternate-language graph of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..storage import Workspace
from .findings import finding, hits


def connected_components(ws: Workspace, edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """(node, component): component is the least node it is connected with. ``edges``: a, b of any ordered type; a node without edges is absent.

    Alternating large-star and small-star steps, each round written out. The number of
    rounds is logarithmic in the longest path. Null ends and self loops are ignored.
    """
    now = ws.table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-start",
    )
    last, before = f"{name}-start", None

    def with_least(pairs: DataFrame) -> DataFrame:
        """m: the least of u and its neighbours. Combined before the shuffle; AQE splits the join's partition of a hub."""
        return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), "u").alias("m")), "u")

    for i in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = with_least(large.distinct())
        flat = F.array(F.struct("v", F.col("m").alias("r")), F.struct(F.col("u").alias("v"), F.col("m").alias("r")))
        step = (
            small.select(F.explode(flat).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.r").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = ws.table(step, f"{name}-{i}")
        ws.drop(last)
        last = f"{name}-{i}"
        state = now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def alternate_occurrences(links: DataFrame) -> DataFrame:
    """(doc, source_key, target_key, hreflang, entry_ix, source_raw, target_raw, rel): each link between two identities.

    ``links``: as ``entry_rules.links`` gives them. Links with a blank href take no part; a URL without a host is its own identity.
    """
    rows = links.where(F.col("href").isNotNull() & (U.trim4(F.col("href")) != "") & F.col("loc").isNotNull())
    rows = U.with_url(U.with_url(rows, "loc", "__s", "source_key"), "href", "__t", "target_key")
    return rows.select(
        "doc_id", "base", "source_key", "target_key", U.trim4(F.col("hreflang")).alias("hreflang"), "entry_ix", F.col("loc").alias("source_raw"), F.col("href").alias("target_raw"), "rel"
    )


def alternate_edges(occurrences: DataFrame) -> DataFrame:
    """One row for each (document, source, target, token), with its occurrences in order; a missing token is a token of its own."""
    one = F.struct(F.col("entry_ix").alias("row"), "source_raw", "target_raw", "hreflang", "rel")
    return occurrences.groupBy("doc_id", "base", "source_key", "target_key", "hreflang").agg(F.count("*").cast("int").alias("n_occurrences"), F.array_sort(F.collect_list(one)).alias("occurrences"))


def alternate_nodes(occurrences: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, url_key, url_raw, node_kind): 'internal' if the corpus lists the URL; the least spelling represents it."""
    both = occurrences.select("doc_id", F.col("source_key").alias("url_key"), F.col("source_raw").alias("raw")).unionByName(
        occurrences.select("doc_id", F.col("target_key").alias("url_key"), F.col("target_raw").alias("raw"))
    )
    listed = entries.select("doc_id", F.col("loc_key").alias("url_key"), F.lit(True).alias("__in")).distinct()
    nodes = both.groupBy("doc_id", "url_key").agg(F.min("raw").alias("url_raw")).join(listed, ["doc_id", "url_key"], "left")
    return nodes.select("doc_id", "url_key", "url_raw", F.when(F.col("__in"), "internal").otherwise("external").alias("node_kind"))


def alternate_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``cluster``: components of each document's graph, numbered from 1 by their least key."""
    ws = Workspace(nodes.sparkSession, "alternates")
    sep = F.lit("\x01")
    comp = connected_components(ws, edges.select(F.concat("doc_id", sep, "source_key").alias("a"), F.concat("doc_id", sep, "target_key").alias("b")))
    out = nodes.withColumn("node", F.concat("doc_id", sep, "url_key")).join(comp, "node", "left")
    out = out.withColumn("root", F.coalesce("component", "node"))
    return out.withColumn("cluster", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("root"))).select(*nodes.columns, "cluster")


def cluster_summary(nodes: DataFrame) -> DataFrame:
    inside = (F.col("node_kind") == "internal").cast("int")
    return nodes.groupBy("doc_id", "cluster").agg(
        F.count("*").cast("int").alias("size"), F.sum(inside).cast("int").alias("n_internal"), F.sum(1 - inside).cast("int").alias("n_external"), F.array_sort(F.collect_list("url_key")).alias("members")
    )


def graph_findings(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing self references, links without a link back (targets inside the corpus only) and targets under several languages."""
    base, source, target = F.col("base"), F.col("source_key"), F.col("target_key")
    edges = Workspace(edges.sparkSession, "graph").table(edges.select("doc_id", "base", "source_key", "target_key", "hreflang"), "edges")  # read by every branch below
    pairs = edges.select("doc_id", "base", "source_key", "target_key").distinct()
    selfs = pairs.where(source == target).select("doc_id", "source_key")
    lonely = pairs.select("doc_id", "base", "source_key").distinct().join(selfs, ["doc_id", "source_key"], "left_anti")
    listed = entries.select("doc_id", F.col("loc_key").alias("target_key")).distinct()
    back = pairs.select("doc_id", F.col("target_key").alias("source_key"), F.col("source_key").alias("target_key"))
    one_way = pairs.where(source != target).join(listed, ["doc_id", "target_key"], "left_semi").join(back, ["doc_id", "source_key", "target_key"], "left_anti")
    tokens = (
        edges.where(F.col("hreflang").isNotNull() & (U.trim4(F.col("hreflang")) != "")).groupBy("doc_id", "base", "target_key")
        .agg(F.count_distinct(F.lower(U.trim4(F.col("hreflang")))).alias("n"), F.array_join(F.array_sort(F.collect_set(U.trim4(F.col("hreflang")))), ", ").alias("label"))
    )
    return (
        hits(lonely, (F.lit(True), finding("HREFLANG_MISSING_SELF_REFERENCE", base, F.concat(source, F.lit(" is not among its own alternates.")), excerpt=source)))
        .unionByName(hits(one_way, (F.lit(True), finding("HREFLANG_NON_RECIPROCAL", base, F.concat(source, F.lit(" links to "), target, F.lit(", which does not link back.")), excerpt=F.concat(source, F.lit(" -> "), target)))))
        .unionByName(hits(tokens, (F.col("n") > 1, finding("HREFLANG_INCONSISTENT_LANGUAGE", base, F.concat(target, F.lit(" is linked as "), F.col("label"), F.lit(".")), excerpt=F.col("label")))))
    )
