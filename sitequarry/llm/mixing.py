"""Mixing sources to target weights by entropy balancing.

Document rates w minimise the token-weighted relative entropy sum(tokens * (w log w - w + 1)) subject to one token constraint
per value of each balanced column. The dual is convex and smooth; its solution tilts exponentially,
w = exp(lambda[source] + ...). For one column the Hessian is diagonal and Newton's method runs value by value, without targets in a
table that never leaves the executors. For several, its gradient and Hessian are distributed sums over the cells (combinations of values that occur, with
their tokens), which one scan of the documents makes; beyond ``MOST`` constraints steps come from conjugate gradients, whose
Hessian-vector products are such sums too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import Workspace, broadcast_if_small, free_names

ALPHA, TOLERANCE, MOST = 0.7, 1e-13, 3000


def token_count(column: str = "text") -> F.Column:
    """Runs of characters other than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def newton(tokens: np.ndarray, goal: np.ndarray, tolerance: float = TOLERANCE, rounds: int = 1000) -> np.ndarray:
    """Multipliers of one column's values: Newton's method on the dual sum(tokens * exp(lambda) - goal * lambda), whose Hessian is diagonal.

    A step is at most 2 up. One too far ends above the solution, from where Newton's steps fall to it, so that none has to be
    halved. After the gradient is within ``tolerance`` of the goal one more step is made. ``tokens`` and ``goal`` must be positive.
    """
    lam = np.zeros(len(tokens))
    for _ in range(rounds):
        hess = tokens * np.exp(lam)
        grad = hess - goal
        lam = lam + np.minimum(2.0, -grad / hess)
        if (np.abs(grad) <= tolerance * goal).all():
            return lam
    raise ValueError("Newton's method did not converge")


def solve(cells: DataFrame, columns: list[str], targets: dict[str, dict[str | None, float]], tolerance: float = TOLERANCE, rounds: int = 100) -> dict[str, dict[str | None, float]]:
    """Multipliers by column and value. ``cells``: the columns and ``tokens``. Values without a target, or without tokens, get 0.

    Every round is one distributed aggregation. Steps are halved until the dual falls; constraints that depend on each other
    (two columns with the same total) are met by the least-norm step. Targets that cannot be met together raise.
    """
    index = [(c, v) for c in columns for v in targets.get(c, {})]
    spark, at = cells.sparkSession, {k: i for i, k in enumerate(index)}
    goal = np.array([targets[c][v] for c, v in index], float)
    if not len(index):
        return {c: {} for c in columns}

    dense = len(index) <= MOST

    def valued(*vectors: np.ndarray) -> tuple[DataFrame, list[F.Column]]:
        """The cells with the numbers of their constraints, and each vector's sum over a cell's constraints."""
        now, sums_of = cells, [F.lit(0.0) for _ in vectors]
        for c in columns:
            rows = [(v, i, *(float(x[i]) for x in vectors)) for (k, v), i in at.items() if k == c]
            lookup = spark.createDataFrame(rows, ", ".join([f"v {cells.schema[c].dataType.simpleString()}, __i_{c} int", *(f"__l{j}_{c} double" for j in range(len(vectors)))]))
            now = now.join(broadcast_if_small(lookup, len(rows), 200), F.col(c).eqNullSafe(F.col("v")), "left").drop("v")
            sums_of = [t + F.coalesce(F.col(f"__l{j}_{c}"), F.lit(0.0)) for j, t in enumerate(sums_of)]
        return now, sums_of

    def by_constraint(now: DataFrame, x: F.Column) -> tuple[float, np.ndarray]:
        """The total of x over the cells, and by constraint."""
        numbers = F.array(F.lit(-1), *[F.col(f"__i_{c}") for c in columns])
        out, total = np.zeros(len(index)), 0.0
        for r in now.select(x.alias("x"), F.explode(numbers).alias("i")).where("i is not null").groupBy("i").agg(F.sum("x").alias("x")).collect():
            if r.i < 0:
                total = r.x
            else:
                out[r.i] = r.x
        return total, out

    def sums(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual, gradient and Hessian; of the Hessian the diagonal only, if there are too many constraints for all of it."""
        now, (tilt,) = valued(lam)
        if not dense:
            total, grad = by_constraint(now, F.col("tokens") * F.exp(tilt))
            return total - float(lam @ goal), grad - goal, grad
        got = now.groupBy(*[f"__i_{c}" for c in columns]).agg(F.sum(F.col("tokens") * F.exp(tilt)).alias("x")).collect()
        total, grad, hess = 0.0, np.zeros(len(index)), np.zeros((len(index), len(index)))
        for r in got:
            own = [r[f"__i_{c}"] for c in columns if r[f"__i_{c}"] is not None]
            total += r.x
            grad[own] += r.x
            hess[np.ix_(own, own)] += r.x
        return total - float(lam @ goal), grad - goal, hess

    def direction(lam: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        step = np.zeros_like(lam)
        if dense:
            step[live] = np.linalg.lstsq(hess[np.ix_(live, live)], -grad[live], rcond=1e-12)[0]
            return step
        scale = np.where(live, 1 / np.where(live, hess, 1), 0.0)
        rest = np.where(live, -grad, 0.0)
        way = scale * rest
        size = start = float(rest @ way)
        for _ in range(len(lam)):
            if size <= 1e-16 * start:
                break
            now, (tilt, along) = valued(lam, way)
            bent = np.where(live, by_constraint(now, F.col("tokens") * F.exp(tilt) * along)[1], 0.0)
            if (curve := float(way @ bent)) <= 0:
                break
            step, rest = step + size / curve * way, rest - size / curve * bent
            size, before = float(rest @ (scale * rest)), size
            way = scale * rest + size / before * way
        return step

    if len(columns) == 1:
        _, now = by_constraint(valued()[0], F.col("tokens").cast("double"))
        if ((now > 0) & (goal <= 0)).any():
            raise ValueError("targets must be positive; leave a source out beforehand instead")
        lam = np.zeros(len(index))
        lam[now > 0] = newton(now[now > 0], goal[now > 0], tolerance)
        return {columns[0]: {v: float(lam[i]) for (_, v), i in at.items()}}

    lam = np.zeros(len(index))
    value, grad, hess = sums(lam)
    diagonal = np.diag(hess) if dense else hess
    live = (diagonal > 0) & (goal > 0)
    lam[(diagonal > 0) & (goal <= 0)] = -np.inf
    if np.isinf(lam).any():
        raise ValueError("targets must be positive; leave a source out beforehand instead")
    for _ in range(rounds):
        if not live.any() or np.max(np.abs(grad[live]) / goal[live]) <= tolerance:
            break
        step = direction(lam, grad, hess)
        size = min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        while True:
            new = sums(lam + size * step)
            if new[0] <= value + 1e-4 * size * float(grad @ step) or size * np.abs(step).max() < 1e-9:
                break
            size /= 2
        lam, (value, grad, hess) = lam + size * step, new
        if size * np.abs(step).max() < 1e-15:
            break
    if live.any() and np.max(np.abs(grad[live]) / goal[live]) > 1e-6:
        raise ValueError("the targets cannot be met together")
    return {c: {v: float(lam[i]) for (k, v), i in at.items() if k == c} for c in columns}


def tempered(cells: DataFrame, column: str, alpha: float, value: str, multiplier: str) -> DataFrame:
    """(value, the column's values that have tokens, and multiplier): tokens in proportion to tokens^alpha, of the same total as now."""
    live = cells.where("tokens > 0").select(F.col(column).alias(value), F.col("tokens").cast("double").alias("t"))
    total = live.agg(F.sum("t").alias("t"), F.sum(F.pow("t", F.lit(alpha))).alias("p")).first()
    goals = live.withColumn("goal", F.pow("t", F.lit(alpha)) * F.lit(total.t / total.p if total.p else 0.0))

    def balance(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lam = newton(b.column("t").to_numpy(), b.column("goal").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lam)], [value, multiplier])

    return goals.mapInArrow(balance, StructType([goals.schema[0], *StructType().add(multiplier, DoubleType())]))


def mix(docs: DataFrame, *, targets: dict[str, dict[str | None, float]] | None = None, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``rate`` (double) and ``copies`` (int), replacing columns of these names.

    ``targets``: tokens wanted by column and value; without it, ``source`` is brought to shares in proportion to tokens^alpha with
    the same total. A null value is a value of its own; values without a target and documents of sources without tokens have
    rate 1. ``copies`` is the rate rounded up or down, up with the probability of its fraction, drawn by md5 of doc_id (null as
    ''): rows of the same doc_id get the same, and a source's expected tokens are its target. Empty and null texts have no tokens
    and get their source's rate; very long ones are counted whole. Other columns may have any names. An empty table gives no rows.
    """
    return _rated(docs.drop("rate", "copies"), targets, alpha, "rate", "copies")


def mixed(docs: DataFrame, *, targets: dict[str, dict[str | None, float]] | None = None, alpha: float = ALPHA) -> DataFrame:
    """``docs``, each row as many times as ``mix`` says, in the same columns, whatever their names. See ``mix`` for nulls, empty texts and repeated rows."""
    rate, copies, copy = free_names(docs, "rate", "copies", "copy")
    out = _rated(docs, targets, alpha, rate, copies).where(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def _rated(docs: DataFrame, targets: dict[str, dict[str | None, float]] | None, alpha: float, rate: str, copies: str) -> DataFrame:
    ws = Workspace(docs.sparkSession, "mix")
    columns = sorted(targets) if targets else ["source"]
    cells = ws.table(docs.select(*columns, token_count().alias("__t")).groupBy(*columns).agg(F.sum("__t").alias("tokens")), "cells")
    lam = solve(cells, columns, targets) if targets else {}
    value, *logs = free_names(docs, "value", *(f"log_{i}" for i in range(len(columns))))
    out, tilt = docs, F.lit(0.0)
    for c, log in zip(columns, logs, strict=True):
        if targets:
            many = len(lam[c])
            lookup = docs.sparkSession.createDataFrame(list(lam[c].items()), f"{value} {docs.schema[c].dataType.simpleString()}, {log} double")
        else:
            lookup, many = tempered(cells, c, alpha, value, log), cells.count()
        out = out.join(broadcast_if_small(lookup, many, 200), docs[c].eqNullSafe(F.col(value)), "left").drop(value)
        tilt = tilt + F.coalesce(F.col(log), F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = out.withColumn(rate, F.round(F.exp(tilt), 9))
    out = out.withColumn(copies, (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("int")).cast("int"))
    return out.select(*docs.columns, rate, copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "rate", "copies")


SQL = f"""
WITH c AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'))) AS tokens FROM documents GROUP BY source
), p AS (
  SELECT source, CASE WHEN tokens > 0 THEN
    pow(tokens, {ALPHA}) * (SELECT sum(tokens) / sum(pow(tokens, {ALPHA})) FROM c WHERE tokens > 0) / tokens ELSE 1 END AS r FROM c
), w AS (
  SELECT d.doc_id, d.source, round(p.r, 9) AS rate,
    ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, rate, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM w
"""
