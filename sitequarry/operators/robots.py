"""robots.txt: sitemap directives, rules, and decisions by the longest matching rule (RFC 9309)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .findings import finding, hits

RULES = "origin string, line_no int, user_agent string, rule_type string, rule_value string"


def sitemap_directives(files: DataFrame) -> DataFrame:
    """(origin, sitemap) of robots.txt ``files`` (origin, text): http(s) URLs, each identity once, in order."""
    lines = files.select("origin", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line"))
    url = F.regexp_extract("line", r"(?i)^\s*site-?map\s*:\s*(\S.*?)\s*$", 1)
    rows = U.with_url(lines.withColumn("sitemap", url).where((F.col("sitemap") != "") & (U.absoluteness(F.col("sitemap")) == "http(s)")), "sitemap")
    first = F.row_number().over(Window.partitionBy("origin", "loc_key").orderBy("line_no"))
    return rows.withColumn("n", first).where("n = 1").select("origin", "line_no", "sitemap")


def product_token(agent: str) -> str:
    """The part of an agent's name that robots.txt goes by, in lower case: 'Googlebot/2.1' is googlebot."""
    agent = agent.strip().lower()
    return "*" if agent.startswith("*") else re.match("[a-z_-]*", agent)[0]


def parse_rules(text: str) -> list[tuple[int, str, str, str | None]]:
    """(line, agent, allow|disallow|group, value): a rule for each agent of its group. Blank lines don't end a group. Each agent line gives a
    row ``group`` without a value, so that a group whose rules are empty, which allows everything, is known to be there."""
    out, agents, open_ = [], [], True
    for n, line in enumerate(re.split("\r\n|\r|\n", text), 1):
        key, sep, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not open_:
                agents, open_ = [], True
            if token := product_token(value):
                agents.append(token)
                out.append((n, token, "group", None))
        elif key in ("allow", "disallow"):
            open_ = False
            out += [(n, a, key, value) for a in agents if value]
    return out


def rules(files: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(o, *r) for o, t in zip(b.column("origin").to_pylist(), b.column("text").to_pylist(), strict=True) for r in parse_rules(t or "")]
            names = ("origin", "line_no", "user_agent", "rule_type", "rule_value")
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select("origin", "text").mapInArrow(run, RULES)


_UNRESERVED = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")


def octets(path: str) -> str:
    """Rules and paths in one spelling: other than ASCII percent-encoded, escapes in upper case, those of unreserved characters undone."""

    def undone(m: re.Match) -> str:
        c = int(m[1], 16)
        return chr(c) if c in _UNRESERVED else f"%{m[1].upper()}"

    path = re.sub("%([0-9a-fA-F]{2})", undone, path)
    return path if path.isascii() else "".join(c if c.isascii() else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in path)


@lru_cache(maxsize=10_000)
def _parts(rule: str) -> tuple[tuple[str, ...], bool]:
    end = rule.endswith("$")
    return tuple(octets(rule[:-1] if end else rule).split("*")), end


def rule_matches(rule: str, path: str) -> bool:
    """Whether a rule's value fits a path: * is anything, a last $ the end. A search for each part in turn, so that no rule is slow."""
    (first, *rest), end = _parts(rule)
    if not path.startswith(first):
        return False
    at = len(first)
    if not rest:
        return not end or at == len(path)
    for part in rest[:-1] if end else rest:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return not end or (len(path) - len(rest[-1]) >= at and path.endswith(rest[-1]))


def _matching(paths: pd.Series, values: pd.Series) -> pd.Series:
    known = {p: octets(p) for p in set(paths)}
    return pd.Series([rule_matches(v, known[p]) for p, v in zip(paths, values, strict=True)], dtype=bool)


def decide(locs: DataFrame, rules: DataFrame, reachable: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """(loc, decision, rule_type, rule_value, line_no): allow, disallow or undetermined for each distinct http(s) loc.

    A rule group for the agent's product token goes before the one for all, even if it is empty. The longest rule wins, allow at equal length. ``reachable``:
    origin, state ('ok', 'absent' for 404 and the like, anything else is undetermined); without it every origin counts as read.
    An equi-join on the origin bounds the pattern tests to the origin's own rules.
    """
    urls = U.with_url(locs.select("loc").where(U.absoluteness(F.col("loc")) == "http(s)").distinct()).where("url.host is not null")
    path = F.concat(F.col("url.path"), F.when(F.col("url.query").isNull(), "").otherwise(F.concat(F.lit("?"), F.col("url.query"))))
    urls = urls.select("loc", U.authority(F.col("url")).alias("origin"), path.alias("path"))
    agent = product_token(agent)
    own = rules.where(F.col("user_agent").isin(agent, "*"))
    named = own.groupBy("origin").agg(F.bool_or(F.col("user_agent") == agent).alias("named"))
    own = own.join(named, "origin").where((F.col("user_agent") == agent) == F.col("named"))
    fits = F.pandas_udf(_matching, "boolean")
    matched = urls.join(own.where("rule_value is not null").drop("user_agent"), "origin").where(fits("path", "rule_value"))
    best = matched.groupBy("loc").agg(F.max_by(F.struct("rule_type", "rule_value", "line_no"), F.struct(F.length("rule_value"), (F.col("rule_type") == "allow").cast("int"), -F.col("line_no"))).alias("r"))
    out = urls.join(best, "loc", "left")
    known = F.lit("ok")
    if reachable is not None:
        out = out.join(reachable.select("origin", "state"), "origin", "left")
        known = F.coalesce("state", F.lit("unknown"))
    decision = F.when(known == "absent", "allow").when(known != "ok", "undetermined").when(F.col("r.rule_type") == "disallow", "disallow").otherwise("allow")
    return out.select("loc", decision.alias("decision"), "r.rule_type", "r.rule_value", "r.line_no", known.alias("state"))


def fetched_files(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files: origin, text; states: origin, state) of robots.txt documents (``schema.DOCUMENT``, asked for as origin/robots.txt).

    A usable answer is read; a 4xx means that there is none, which allows everything; anything else leaves the origin undetermined.
    """
    rows = documents.withColumn("origin", F.regexp_replace("requested_url", "/robots\\.txt$", ""))
    good = F.col("status").between(200, 299) & F.col("error_class").isNull()
    state = F.when(good, "ok").when(F.col("status").between(400, 499), "absent").otherwise(F.coalesce("error_class", F.lit("unreachable")))
    return rows.where(good).select("origin", F.decode("content", "UTF-8").alias("text")), rows.select("origin", state.alias("state"))


def robots_findings(subjects: DataFrame, decisions: DataFrame) -> DataFrame:
    """``subjects``: base, loc. A loc without a decision is undetermined."""
    rows = subjects.where(U.absoluteness(F.col("loc")) == "http(s)").select("base", "loc").distinct().join(decisions, "loc", "left").withColumn("decision", F.coalesce("decision", F.lit("undetermined")))
    ref, rule = F.concat(F.col("base"), F.lit("#page-url:"), F.col("loc")), F.concat("rule_type", F.lit(": "), "rule_value")
    return hits(
        rows,
        (F.col("decision") == "disallow", finding("ROBOTS_DISALLOWED", ref, F.concat(F.col("loc"), F.lit(" is disallowed by robots.txt ("), rule, F.lit(").")), excerpt=rule, line=F.col("line_no"))),
        (F.col("decision") == "undetermined", finding("ROBOTS_INDETERMINATE", ref, F.concat(F.lit("robots.txt of "), F.col("loc"), F.lit(" could not be read: "), F.coalesce("state", F.lit("not fetched"))))),
    )


def robots_sitemap_findings(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """``documents``: base, sitemap_url."""
    rows = documents.join(decisions.where("decision = 'disallow'"), F.col("sitemap_url") == F.col("loc"))
    rule = F.concat("rule_type", F.lit(": "), "rule_value")
    return hits(rows, (F.lit(True), finding("ROBOTS_SITEMAP_DISALLOWED", F.col("base"), F.concat(F.lit("The sitemap itself is disallowed by robots.txt ("), rule, F.lit(").")), excerpt=rule, line=F.col("line_no"))))
