"""Documents and what is parsed from them: one Arrow pass over the bytes, everything else is projections of it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.urls import base_ref
from ..functions.values import parse_lastmod, parse_priority
from ..limits import ArchiveLimits
from ..schema import ALTERNATE, DOCUMENT, ENTRY, IMAGE, NEWS, URLS, VIDEO, columns
from . import raw, xmltree, xsd

_ENTRY = f"struct<loc:string,lastmod:string,changefreq:string,priority:string,images:array<{IMAGE}>,video:array<{VIDEO}>,news:array<{NEWS}>,alternates:array<{ALTERNATE}>,member:string>"
PARSED = (
    "doc_id string, requested_url string, final_url string, path string, status int, content_type string, fetched_at timestamp, redirect_chain array<string>, timing double, format string, kind string, gzip boolean, byte_size long, "
    "root string, variant string, namespaces array<string>, bom string, declared string, error_class string, error string, "
    f"entries array<{_ENTRY}>, children array<struct<loc:string,lastmod:string>>, lines array<string>, "
    "schema_issues array<struct<namespace:string,element:string,reason:string,excerpt:string>>, unknown_namespaces array<string>, entities boolean, "
    "members array<struct<severity:string,member:string,message:string>>"
)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Local or distributed files as documents."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.col("path").alias("doc_id"), F.col("path").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), "path", "content", F.col("length").alias("byte_size"),
        F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(None).cast("string").alias("error_class"),
    )


def from_bytes(spark: SparkSession, documents: list[tuple[str, bytes]]) -> DataFrame:
    """(URL or path, bytes) pairs as documents."""
    rows = [(u, u, u if "://" in u else None, u, bytearray(b), len(b), 200 if "://" in u else None, None, None, None) for u, b in documents]
    return spark.createDataFrame(rows, DOCUMENT)


def split_lines(text: str) -> list[str]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines and lines[-1] == "" else lines


def _text_entries(lines: list[str]) -> list[dict]:
    none = {"lastmod": None, "changefreq": None, "priority": None, "images": [], "video": [], "news": [], "alternates": []}
    return [{"loc": t} | none for line in lines if (t := line.strip(" \t\r\n"))]


def _bom(data: bytes) -> str | None:
    return "UTF-8" if data[:3] == b"\xef\xbb\xbf" else "UTF-16LE" if data[:2] == b"\xff\xfe" else "UTF-16BE" if data[:2] == b"\xfe\xff" else None


def _member(m: raw.Member, most: int) -> tuple[list[dict] | None, str]:
    """Entries of an archive's member, or why it is passed over."""
    name, data = m.name, m.content
    if not data:
        return None, "empty member"
    if raw.sniff(data) == "gzip":
        data = raw.gunzip(data, most)
        name = name[:-3] if name.lower().endswith(".gz") else name
    ext = name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    fmt = raw.sniff(data)
    if ext not in ("xml", "txt"):
        return None, f"a .{ext} file is no sitemap" if ext else "a file without extension is no sitemap"
    if ext == "txt":
        return (_text_entries(split_lines(data.decode("utf-8", "replace"))), "") if fmt == "text" else (None, "the .txt member holds no text")
    if fmt == "xml-urlset":
        return xmltree.entries(xmltree.parse(data).root), ""
    return None, "an index within an archive is not expanded" if fmt == "xml-sitemapindex" else "the XML is no sitemap"


def _archive(data: bytes, out: dict, limits: ArchiveLimits) -> None:
    out["kind"] = "archive"
    if len(data) > limits.max_decompressed_bytes:
        raise raw.SourceError("archive_limit_bytes", "The archive inflates beyond the limit.")
    entries, notes = [], []
    for n, m in enumerate([m for m in raw.tar_members(data) if m.regular], 1):
        if n > limits.max_file_count:
            raise raw.SourceError("archive_limit_files", f"The archive has more than {limits.max_file_count} files.")
        if raw.unsafe_name(m.name):
            notes.append({"severity": "warning", "member": m.name, "message": f"The member's name {m.name!r} leads out of the archive."})
            continue
        rows, why = _member(m, limits.max_decompressed_bytes)
        if rows is None:
            notes.append({"severity": "info", "member": m.name, "message": f"{m.name} is passed over: {why}."})
        else:
            entries += [r | {"member": m.name} for r in rows]
    out |= {"entries": entries, "members": notes}


def parse_bytes(data: bytes | None, limits: ArchiveLimits = ArchiveLimits()) -> dict:
    """All that ``PARSED`` has of a document's bytes."""
    data = bytes(data or b"")
    out: dict = {
        "format": raw.sniff(data), "gzip": False, "kind": "error", "byte_size": len(data), "entries": [], "children": [], "lines": [], "schema_issues": [], "unknown_namespaces": [], "namespaces": [],
        "members": [], "entities": False,
    }
    try:
        if out["format"] == "gzip":
            size = len(data)
            data, out["gzip"] = raw.gunzip(data), True
            out["format"], out["byte_size"] = raw.sniff(data), len(data)
            if out["format"] == "tar":
                if size > limits.max_archive_bytes:
                    raise raw.SourceError("archive_limit_bytes", "The archive is larger than the limit.")
                out["byte_size"] = size
        fmt, out["bom"] = out["format"], _bom(data)
        if fmt == "tar":
            _archive(data, out, limits)
        elif fmt == "html":
            out["kind"] = "html"
        elif fmt == "text":
            out["lines"] = split_lines(data.decode("utf-8", "replace"))
            out |= {"kind": "text", "entries": _text_entries(out["lines"])}
        elif fmt in ("binary", "empty"):
            raise raw.SourceError("xml_parse_error", f"A sitemap is expected; the content is {fmt}.")
        else:
            doc = xmltree.parse(data)
            out |= {"root": doc.root.name, "declared": doc.declared, "entities": doc.entities, "namespaces": sorted({e.ns for e in xmltree.walk(doc.root) if e.ns})}
            if fmt == "feed":
                out |= {"kind": "feed", "variant": xmltree.feed_variant(doc.root), "entries": xmltree.feed_entries(doc.root)}
            elif doc.root.name in ("urlset", "sitemapindex"):
                out["unknown_namespaces"] = xsd.unknown_namespaces(doc.root)
                if not out["unknown_namespaces"]:
                    out["schema_issues"] = [dict(zip(("namespace", "element", "reason", "excerpt"), i, strict=True)) for i in xsd.issues(doc.root)]
                if doc.root.name == "urlset":
                    out |= {"kind": "urlset", "entries": xmltree.entries(doc.root)}
                else:
                    out |= {"kind": "index", "children": xmltree.index_children(doc.root)}
            else:
                out |= {"kind": "other", "format": "xml"}
    except raw.SourceError as e:
        out |= {"error_class": e.error_class, "error": str(e), "entries": [], "children": [], "lines": []}
        out["kind"] = "error"
    return out


def parse(documents: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """``PARSED`` of documents with the columns of ``schema.DOCUMENT`` or ``schema.FETCHED``; the bytes go no further."""
    from pyspark.sql.types import _parse_datatype_string

    schema: StructType = _parse_datatype_string(PARSED)  # type: ignore[assignment]
    arrow = to_arrow_schema(schema)
    keep = ["doc_id", "requested_url", "final_url", "path", "status", "content_type", "fetched_at", *(c for c in ("redirect_chain", "timing") if c in documents.columns)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a document at a time: one may be very large
                row = {c: batch.column(c)[i].as_py() for c in keep}
                failed = batch.column("error_class")[i].as_py()
                own = {"kind": "error", "error_class": failed, "error": failed} if failed else parse_bytes(batch.column("content")[i].as_py(), limits)
                for k in ("entries", "children", "lines", "schema_issues", "unknown_namespaces", "namespaces", "members"):
                    own.setdefault(k, [])
                yield pa.RecordBatch.from_pylist([row | own], schema=arrow)

    return documents.select(*keep, "content", "error_class").mapInArrow(run, schema)


def with_base(parsed: DataFrame) -> DataFrame:
    where = F.coalesce("final_url", "requested_url", "path", "doc_id")
    return parsed.withColumn("base", base_ref(where)).withColumn("sitemap_url", F.col("final_url"))


def entries(parsed: DataFrame) -> DataFrame:
    """One row an entry, numbered from 1 in document order (``schema.ENTRY``). ``parsed``: as ``with_base`` gives it."""
    rows = parsed.select("doc_id", "base", "sitemap_url", F.posexplode("entries").alias("__i", "e"))
    source = F.coalesce(F.col("sitemap_url"), F.col("doc_id"))
    source = F.when(F.col("e.member").isNull(), source).otherwise(F.concat(source, F.lit("#archive-member:"), F.col("e.member")))
    fields = [F.col(f"e.{c}").alias(c) for c in columns(ENTRY)[4:-1]]
    return rows.select("doc_id", "base", "sitemap_url", (F.col("__i") + 1).alias("entry_ix"), *fields, source.alias("source_sitemap"))


def text_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'text'").select("doc_id", "base", F.posexplode("lines").alias("__i", "raw")).select("doc_id", "base", (F.col("__i") + 1).alias("line_no"), "raw")


def children(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("kind = 'index'").select("doc_id", "base", "sitemap_url", F.posexplode("children").alias("__i", "c"))
    return rows.select("doc_id", "base", "sitemap_url", (F.col("__i") + 1).alias("child_ix"), "c.loc", parse_lastmod(F.col("c.lastmod")).alias("lastmod"))


def urls(entries: DataFrame) -> DataFrame:
    """The public typed rows: lastmod a timestamp, priority a double, null where they cannot be read."""
    typed = {"lastmod": parse_lastmod(F.col("lastmod")), "priority": parse_priority(F.col("priority"))}
    return entries.select(*[typed.get(c, F.col(c)).alias(c) for c in columns(URLS)])


def sources(parsed: DataFrame) -> DataFrame:
    """``schema.SOURCES``, a row a document."""
    charset = F.regexp_extract(F.lower(F.col("content_type")), r"charset=[\"']?([^\s;\"']+)", 1)
    return parsed.select(
        "requested_url", "final_url", "status", F.coalesce("redirect_chain", F.array().cast("array<string>")).alias("redirect_chain"), "content_type", F.nullif(charset, F.lit("")).alias("charset"), F.col("byte_size").alias("bytes"),
        "timing", "error_class", "format", F.col("root"), F.col("namespaces"),
        F.when(F.col("kind").isin("urlset", "index"), F.concat_ws("|", F.lit("1"), "root", F.array_join(F.array_sort("namespaces"), ","))).alias("profile_id"),
    )


def problems(parsed: DataFrame) -> DataFrame:
    """``schema.PROBLEMS``: failures, members passed over and errors that do not end a run."""
    failed = parsed.where("error_class is not null").select(F.lit("error").alias("severity"), F.lit("parse").alias("category"), F.col("base").alias("subject_ref"), F.coalesce("error", "error_class").alias("message"))
    members = parsed.select("base", F.explode("members").alias("m")).select("m.severity", F.lit("classification").alias("category"), F.concat(F.col("base"), F.lit("#archive-member:"), F.col("m.member")).alias("subject_ref"), "m.message")
    http = parsed.where("status is not null and not (status between 200 and 299)").select(
        F.lit("warning").alias("severity"), F.lit("fetch").alias("category"), F.col("base").alias("subject_ref"), F.concat(F.lit("HTTP status "), F.col("status").cast("string")).alias("message")
    )
    return failed.unionByName(members).unionByName(http)
