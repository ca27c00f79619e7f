"""What the two near-duplicate operators share: links of buckets that may be hot, and exact verification of connected groups, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, connected_components, key_runs

#: Rows of a bucket that one task may hold; members of a block of a large group.
BUCKET, BLOCK_MEMBERS = 50_000, 2048


def bucket_links(ws: Workspace, rows: DataFrame, keys: DataFrame, meet: Callable[[DataFrame], DataFrame], leader: Column | None = None) -> DataFrame:
    """Links (a, b) of all buckets. ``rows``: key, d (binary) and what ``meet`` needs; ``keys``: their keys alone, cheaper to get.

    A bucket of more than ``BUCKET`` rows is dealt over tasks, each of which gets the bucket's leader too (the least d, of the rows
    that ``leader`` allows): what is connected with the leader anywhere is connected; other rows, strays, go to every task of the
    bucket in a second turn, where they meet all the rest. ``meet`` gives links of each bucket; for rows with a column ``lead``
    also a row of null b for each stray a.
    """
    hot = ws.table(keys.groupBy("key").count().where(F.col("count") > BUCKET), "hot")
    many = hot.count()
    if not many:
        return ws.table(meet(rows), "met")
    own = rows.join(broadcast_if_small(hot, many, 32), "key")
    dealt = own.withColumn("parts", F.ceil(F.col("count") / BUCKET).cast("int")).withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")))
    leaders = (own if leader is None else own.where(leader)).groupBy("key").agg(F.min("d").alias("d")).withColumn("lead", F.lit(True))
    lead = F.coalesce("lead", F.lit(False)) & (F.lit(True) if leader is None else leader)
    home = ws.table(dealt.join(leaders, ["key", "d"], "left").withColumn("lead", lead), "dealt")
    cell = F.xxhash64("key", "part").alias("key")
    kept = [c for c in rows.columns if c != "key"]

    def everywhere(some: DataFrame) -> DataFrame:
        return some.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    first = home.where("not lead").unionByName(everywhere(home.where("lead")))
    first = ws.table(meet(first.select(cell, *kept, "lead")), "met-hot")
    met = meet(rows.join(broadcast_if_small(hot, many, 32), "key", "left_anti").select("key", *kept)).unionByName(first.where("b is not null"))
    strays = home.join(first.where("b is null").select(F.col("a").alias("d")).distinct(), "d", "left_semi")  # a stray of one bucket is asked for in all
    strays = ws.table(everywhere(strays), "strays")
    if strays.head(1):
        met = met.unionByName(meet(home.select(cell, *kept).unionByName(strays.select(cell, *kept))))
    return ws.table(met, "met")


def roots(hit: np.ndarray) -> np.ndarray:
    """The first row of each row's component, of a symmetric matrix of links."""
    label = np.arange(len(hit))
    for i in range(len(hit)):
        own = np.unique(label[np.append(np.flatnonzero(hit[i, i:]) + i, i)])
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    return label


def in_blocks(ws: Workspace, members: DataFrame, weight: Column, most: int) -> DataFrame:
    """``members`` (d, component, ...) with ``blocks`` of their component and their own ``block``: of ``BLOCK_MEMBERS`` rows and ``most`` of weight on average."""
    size = members.groupBy("component").agg(F.greatest(F.ceil(F.sum(weight) / most), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    return ws.table(members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")), "blocks")


def verified(ws: Workspace, held: DataFrame, similar: Callable[[list[bytes]], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """((d, links): how many other members each is similar to; (d, root): the connected group of each that is similar to any).

    ``held``: d, payload, component, block, blocks. ``similar``: which of these payloads are (a symmetric matrix). Every pair of a
    component's blocks is looked at by itself, so that a task holds two blocks whatever the size of the component.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = held.select("d", "payload", "component", "block", "blocks", other).select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "d", "payload",
        F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), (F.col("blocks") == 1).alias("alone"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in key_runs(batches, "key"):
            d, payload, side = t.column("d").to_pylist(), t.column("payload"), t.column("side").to_numpy()
            alone = t.column("alone").to_pylist()
            node, root, links, whole = [], [], [], []
            for lo, hi in zip(runs[:-1], runs[1:], strict=True):
                at = [i for i in range(lo, hi) if i == lo or d[i] != d[i - 1]]
                if len(at) < 2:
                    continue
                hit = similar([payload[i].as_py() for i in at])
                if side[lo] >= 0:
                    hit &= side[at][:, None] != side[at][None]
                count, first = hit.sum(axis=1), roots(hit)
                for i in np.flatnonzero(count):
                    node.append(d[at[i]]), root.append(d[at[first[i]]]), links.append(int(count[i])), whole.append(alone[lo])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64()), pa.array(whole, pa.bool_())], ["d", "root", "links", "whole"])

    found = ws.table(cells.repartition("key").sortWithinPartitions("key", "d").mapInArrow(run, "d binary, root binary, links long, whole boolean"), "verified")
    parts = found.where("not whole")
    group = found.where("whole").select("d", "root")
    if parts.head(1):
        group = group.unionByName(connected_components(ws, parts.select(F.col("d").alias("a"), F.col("root").alias("b")), "groups").select(F.col("node").alias("d"), F.col("component").alias("root")))
    return found.groupBy("d").agg(F.sum("links").alias("links")), group


def classes(ws: Workspace, own: DataFrame, bare: DataFrame, links: DataFrame, group: DataFrame) -> DataFrame:
    """(id, class_id, copies, links) of ``own``: (id, d), distinct, and of the ids of ``bare``, which are alone."""
    sets = own.groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    sets = sets.join(group, "d", "left").join(links, "d", "left").withColumn("root", F.coalesce("root", "d"))
    sets = ws.table(sets.join(sets.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("d", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    alone = bare.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return own.join(sets, "d").select("id", "class_id", "copies", "links").unionByName(alone)
