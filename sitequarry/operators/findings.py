"""The findings relation: one struct a rule hit, modes, engine rulesets, canonical order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..rulesets import PROVENANCE, SEVERITY, Ruleset

COLUMNS = schema.columns(schema.FINDING)
_BARE = [c for c in COLUMNS if c != "mode"]


@dataclass(frozen=True)
class Finding:
    """What a rule says about a row it hits; severity and subject type default to the registry's."""

    code: str
    ref: Column
    message: Column | str
    excerpt: Column | None = None
    line: Column | None = None
    severity: str | None = None
    subject: str | None = None


def finding(code: str, ref: Column, message: Column | str, **more) -> Finding:
    return Finding(code, ref, message, **more)


def _by_rule(values: list, kind: str) -> Column:
    """CASE over the rule's number; rules with the same value share a branch."""
    null = F.lit(None).cast(kind)
    groups: dict[str, tuple[Column, list[int]]] = {}
    for i, v in enumerate(values):
        c = null if v is None else v if isinstance(v, Column) else F.lit(v)
        groups.setdefault(str(c), (c, []))[1].append(i)
    (out, _), *rest = sorted(groups.values(), key=lambda g: -len(g[1]))
    for c, ids in rest:
        out = F.when(F.col("__rule").isin(ids), c).otherwise(out)
    return out


def hits(rows: DataFrame, *rules: tuple[Column, Finding]) -> DataFrame:
    """Findings of (predicate, finding) rules in one pass over the rows, whatever the number of rules.

    The predicates make an array of rule numbers; only rows that are hit go on to have references, messages and excerpts built. A
    null predicate is no hit.
    """
    found = [f for _, f in rules]
    known = [schema.REGISTRY[f.code] for f in found]
    numbers = F.array(*[F.when(p, F.lit(i)) for i, (p, _) in enumerate(rules)])
    hit = rows.withColumn("__rule", F.explode(numbers)).where("__rule is not null")
    return hit.select(
        _by_rule([f.code for f in found], "string").alias("code"),
        _by_rule([f.severity or c.severity for f, c in zip(found, known, strict=True)], "string").alias("severity"),
        _by_rule([c.layer for c in known], "string").alias("layer"),
        _by_rule([f.subject or c.subject_type for f, c in zip(found, known, strict=True)], "string").alias("subject_type"),
        _by_rule([f.ref for f in found], "string").alias("subject_ref"),
        _by_rule([f.message for f in found], "string").alias("message"),
        F.struct(
            F.substring(_by_rule([f.excerpt for f in found], "string"), 1, 500).alias("excerpt"),
            _by_rule([None if f.line is None else f.line.cast("int") for f in found], "int").alias("line"),
            F.lit(None).cast("int").alias("column"),
        ).alias("evidence"),
        _by_rule([c.is_strict_only for c in known], "boolean").alias("is_strict_only"),
        _by_rule([schema.hint(f.code) for f in found], "string").alias("remediation_hint"),
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.FINDING).select(*_BARE)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*_BARE) for p in parts])


def _rank(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]), F.col(column)), F.lit(len(values)))


def order(findings: DataFrame) -> DataFrame:
    """Layer, severity, subject and code, as bytes; then message, so that the order is total."""
    return findings.orderBy(_rank("layer", schema.LAYERS), _rank("severity", schema.SEVERITIES), F.asc_nulls_last("subject_ref"), "code", "message")


def apply_mode(findings: DataFrame, mode: str) -> DataFrame:
    """non-strict leaves strict-only findings out and turns schema errors into warnings; strict raises two codes to warnings."""
    if mode not in schema.MODES:
        raise ValueError(f"mode must be one of {schema.MODES}")
    if mode == "non-strict":
        soft = (F.col("layer") == "schema") & F.col("severity").isin("fatal", "error")
        out = findings.where(~F.col("is_strict_only")).withColumn("severity", F.when(soft, "warning").otherwise(F.col("severity")))
    else:
        up = F.col("code").isin(*schema.STRICT_ELEVATIONS) & (F.col("severity") == "info")
        out = findings.withColumn("severity", F.when(up, "warning").otherwise(F.col("severity")))
    return out.withColumn("mode", F.lit(mode))


def dedup(findings: DataFrame) -> DataFrame:
    """One row for each code, subject, severity and message; evidence doesn't count (the least stays)."""
    keys = [c for c in findings.columns if c not in ("evidence", "context")]
    rest = [c for c in ("evidence", "context") if c in findings.columns]
    return findings.groupBy(*keys).agg(*[(F.min(c) if c == "evidence" else F.first(c)).alias(c) for c in rest]).select(*findings.columns)


def _lookup(values: dict[str, str], default: Column) -> Column:
    if not values:
        return default
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("code")), default)


def stamp(findings: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Adds ruleset, revision, context and provenance, and the engine's own severities. Columns ``extra_context`` (map) and
    ``own_provenance``, where a rule gives them, go before the general ones."""
    context = F.create_map(*[F.lit(x) for k, v in ruleset.context_items() for x in (k, v)]).cast("map<string,string>")
    if "extra_context" in findings.columns:
        extra = F.coalesce(F.col("extra_context"), F.create_map().cast("map<string,string>"))
        context = F.map_concat(F.map_filter(context, lambda k, _: ~F.map_contains_key(extra, k)), extra)
    provenance = _lookup(PROVENANCE.get(ruleset.name, {}), F.lit("inherited_protocol"))
    if "own_provenance" in findings.columns:
        provenance = F.coalesce(F.col("own_provenance"), provenance)
    return (
        findings.withColumn("ruleset", F.lit(ruleset.name))
        .withColumn("ruleset_revision", F.lit(ruleset.revision))
        .withColumn("context", context)
        .withColumn("provenance", provenance)
        .withColumn("severity", _lookup(SEVERITY.get(ruleset.name, {}), F.col("severity")))
        .drop("extra_context", "own_provenance")
    )


def assemble(spark: SparkSession, parts: list[DataFrame], mode: str = "strict", ruleset: Ruleset | None = None, *, ordered: bool = True) -> DataFrame:
    """Union, mode, dedup, ruleset, order. ``ordered=False`` leaves the global sort out, for use inside a larger job."""
    found = dedup(apply_mode(union(parts) if parts else empty(spark), mode)).select(*COLUMNS)
    if ruleset is not None:
        found = stamp(found, ruleset)
    return order(found) if ordered else found
