"""The validation plan: parsed documents -> rule sets -> findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import ProtocolLimits
from ..operators import document_rules as D
from ..operators import entry_rules as E
from ..operators import graph as G
from ..operators.findings import assemble, finding, hits
from ..rulesets import Ruleset
from ..sources import documents as S


def schema_findings(parsed: DataFrame) -> DataFrame:
    """One finding for each wrong element of a document; documents with unknown namespaces or entities get one of their own."""
    base = F.col("base")
    wrong = parsed.where("not entities").select("base", F.explode("schema_issues").alias("i"))
    ref = F.concat(base, F.lit("#field:"), F.col("i.element"))
    found = hits(wrong, (F.lit(True), finding("SCHEMA_INVALID", ref, F.concat(F.lit("<"), F.col("i.element"), F.lit(">: "), F.col("i.reason"), F.lit(".")), excerpt=F.col("i.excerpt"))))
    return found.unionByName(
        hits(
            parsed,
            (F.col("entities"), finding("SCHEMA_INVALID", base, F.lit("The document declares entities; they are not expanded."), subject="document")),
            (F.size("unknown_namespaces") > 0, finding("SCHEMA_UNKNOWN_NAMESPACE", base, F.concat(F.lit("No schema is known for "), F.array_join("unknown_namespaces", ", "), F.lit(".")))),
        )
    )


def error_findings(parsed: DataFrame) -> DataFrame:
    cls, base = F.col("error_class"), F.col("base")
    special = ["malformed_gzip", "malformed_archive", "archive_limit_files", "timeout", "body_ceiling"]
    text = F.coalesce("error", "error_class")
    members = parsed.select("base", F.explode("members").alias("m")).where("m.severity = 'info'")
    return hits(
        parsed,
        (cls == "malformed_gzip", finding("UNSUPPORTED_MALFORMED_GZIP", base, text)),
        (cls == "malformed_archive", finding("UNSUPPORTED_MALFORMED_ARCHIVE", base, text)),
        (cls == "archive_limit_files", finding("DECOMPRESS_TOO_MANY_FILES", base, text)),
        (cls == "timeout", finding("FETCH_TIMEOUT", base, text)),
        (cls == "body_ceiling", finding("FETCH_BODY_CEILING_EXCEEDED", base, text)),
        (cls.isNotNull() & ~cls.isin(*special), finding("FETCH_FAILED", base, text)),
    ).unionByName(hits(members, (F.lit(True), finding("DECOMPRESS_NOT_SITEMAP", F.concat(base, F.lit("#archive-member:"), F.col("m.member")), F.col("m.message")))))


def protocol_parts(entries: DataFrame, documents: DataFrame, ruleset: Ruleset | None = None, limits: ProtocolLimits = ProtocolLimits()) -> list[DataFrame]:
    """All rules of keyed XML, feed and archive entries; ``documents``: doc_id, byte_size, fetched_at."""
    links = E.links(entries)
    return [
        E.loc_findings(entries, ruleset),
        E.field_findings(entries, ruleset),
        E.duplicate_findings(entries),
        E.extension_findings(entries, limits),
        E.hreflang_findings(links),
        G.graph_findings(G.alternate_edges(G.alternate_occurrences(links)), entries),
        D.document_findings(entries, documents, limits),
    ]


def findings_parts(parsed: DataFrame, ruleset: Ruleset | None = None, limits: ProtocolLimits = ProtocolLimits(), *, fetched_at: bool = False, encodings: bool = False, kinds: set[str] | None = None) -> list[DataFrame]:
    """``parsed``: as ``with_base`` gives it. Two rules need facts that a plain run leaves out, and are off by default: lastmods
    near the time of the fetch (``fetched_at``) and encoding conflicts (``encodings``). ``kinds``, if known, are the kinds of
    document there are; rules of other kinds are left out of the plan."""
    some = lambda *names: kinds is None or bool(kinds & set(names))
    parts = [error_findings(parsed), D.classification_findings(parsed, ruleset)]
    if some("urlset", "index"):
        parts.append(schema_findings(parsed))
    if some("text"):
        parts.append(E.text_findings(S.text_lines(parsed)))
    if some("urlset", "feed", "archive"):
        xml = parsed.where("kind in ('urlset', 'feed', 'archive')")
        sized = xml.select("doc_id", "byte_size", (F.col("fetched_at") if fetched_at else F.lit(None).cast("timestamp")).alias("fetched_at"))
        parts += protocol_parts(E.keyed(S.entries(xml)), sized, ruleset, limits)
    if encodings:
        charset = F.nullif(F.regexp_extract(F.lower(F.col("content_type")), r"charset=[\"']?([^\s;\"']+)", 1), F.lit(""))
        parts.append(D.encoding_findings(parsed.withColumn("http_charset", charset)))
    return parts


def validate(parsed: DataFrame, mode: str = "strict", ruleset: Ruleset | None = None, *, ordered: bool = True, **how) -> DataFrame:
    """Findings of parsed documents in the canonical contract."""
    return assemble(parsed.sparkSession, findings_parts(parsed, ruleset, **how), mode, ruleset, ordered=ordered)
