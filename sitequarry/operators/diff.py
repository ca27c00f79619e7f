"""Differences between two audits, a component at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key and ignored columns of each component; '*': a row is its own key, so that nothing can be changed.
SPECS: dict[str, tuple[list[str] | str, tuple[str, ...]]] = {
    "urls": (["loc"], ()),
    "findings": ("*", ()),
    "sources": (["requested_url"], ("timing",)),
    "problems": ("*", ()),
    "tree": (["sitemap_url", "parent_sitemap", "depth"], ()),
}


def _content(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one string in which a null differs from any text."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}) if columns else F.lit("")


def diff(old: DataFrame, new: DataFrame, key: list[str] | str, ignore: tuple[str, ...] = (), order: list[str] | None = None) -> dict[str, DataFrame]:
    """'added' and 'removed' rows, and 'changed' ones with both contents, each sorted by key.

    Of several rows with a key the first in ``order`` (by content without it) stands for it when contents are compared.
    """
    columns = list(dict.fromkeys([*old.columns, *new.columns])) if key == "*" else key
    both = [c for c in new.columns if c in old.columns and c not in ignore]
    o = old.withColumn("__key", _content(old, [c for c in columns if c in old.columns]))
    n = new.withColumn("__key", _content(new, [c for c in columns if c in new.columns]))
    added = n.join(o.select("__key").distinct(), "__key", "left_anti").orderBy("__key").select(*new.columns)
    removed = o.join(n.select("__key").distinct(), "__key", "left_anti").orderBy("__key").select(*old.columns)

    def first(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn(name, _content(df, both))
        w = Window.partitionBy("__key").orderBy(*(order or [name]))
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("__key", name)

    changed = first(o, "old").join(first(n, "new"), "__key").where("old <> new").orderBy("__key").withColumnRenamed("__key", "key")
    return {"added": added, "removed": removed, "changed": changed if key != "*" else changed.limit(0)}


def counts(parts: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """(component, change, n) of a whole comparison."""
    each = [df.agg(F.lit(c).alias("component"), F.lit(k).alias("change"), F.count("*").alias("n")) for c, p in parts.items() for k, df in p.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out
