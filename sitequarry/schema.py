"""Relations, enumerations and the code registry: the engine's fixed data model."""

from __future__ import annotations

from dataclasses import dataclass

LAYERS = tuple("input fetch discovery classification decompression schema protocol index-expansion page robots report".split())
SEVERITIES = tuple("fatal error warning info".split())
MODES = ("strict", "non-strict")
STRICT_ELEVATIONS = ("ENCODING_BOM_DECLARATION_CONFLICT", "PROTOCOL_LASTMOD_LOOKS_GENERATED")
CHANGEFREQ = tuple("always hourly daily weekly monthly yearly never".split())
FORMATS = tuple("gzip tar xml-urlset xml-sitemapindex feed xml html text binary empty".split())

IMAGE = "struct<loc:string,caption:string,geo_location:string,title:string,license:string>"
NEWS = (
    "struct<publication:struct<name:string,language:string>,access:string,genres:string,publication_date:string,title:string,keywords:string,stock_tickers:string>"
)
VIDEO = (
    "struct<thumbnail_loc:string,title:string,description:string,content_loc:string,player_loc:string,player_allow_embed:string,player_autoplay:string,duration:string,"
    "expiration_date:string,rating:string,view_count:string,publication_date:string,tags:array<string>,category:string,family_friendly:string,restriction:string,"
    "has_restriction:boolean,restriction_relationship:string,gallery_loc:string,requires_subscription:string,uploader:string,uploader_info:string,has_platform:boolean,platform:string,"
    "platform_relationship:string,live:string>"
)
ALTERNATE = "struct<rel:string,hreflang:string,href:string,media:string>"

ENTRY = (
    "doc_id string, base string, sitemap_url string, entry_ix int, loc string, lastmod string, changefreq string, priority string, "
    f"images array<{IMAGE}>, video array<{VIDEO}>, news array<{NEWS}>, alternates array<{ALTERNATE}>, source_sitemap string"
)
URLS = (
    f"loc string, lastmod timestamp, changefreq string, priority double, images array<{IMAGE}>, video array<{VIDEO}>, news array<{NEWS}>, "
    f"alternates array<{ALTERNATE}>, source_sitemap string"
)
SOURCES = (
    "requested_url string, final_url string, status int, redirect_chain array<string>, content_type string, charset string, bytes long, timing double, "
    "error_class string, format string, root string, namespaces array<string>, profile_id string"
)
DOCUMENT = "doc_id string, requested_url string, final_url string, path string, content binary, byte_size long, status int, content_type string, fetched_at timestamp, error_class string"
#: What a fetched document has besides: the URLs it led over, the last one included, and the seconds it took.
FETCHED = DOCUMENT + ", redirect_chain array<string>, timing double"
FINDING = (
    "code string, severity string, layer string, subject_type string, subject_ref string, message string, "
    "evidence struct<excerpt:string,line:int,column:int>, mode string, is_strict_only boolean, remediation_hint string"
)
STAMPED = FINDING + ", ruleset string, ruleset_revision string, context map<string,string>, provenance string"
PROBLEMS = "severity string, category string, subject_ref string, message string"
TREE = "depth int, parent_sitemap string, sitemap_url string, page_count int, gzip boolean, status string, reason string, provenance string"
SOURCE_RECORD = (
    "original_input string, normalized_url string, scheme string, host string, port int, path string, query string, fragment string, "
    "is_local_file boolean, scheme_inferred boolean, provenance string, loc_key string"
)
CANDIDATES = "candidate_url string, catalog_path string, kind string, source string, provenance string, status string, reason string, http_status int, final_url string"

_REGISTRY = """
fetch fatal source FETCH_FAILED FETCH_TIMEOUT FETCH_BODY_CEILING_EXCEEDED
classification error source UNSUPPORTED_ROOT UNSUPPORTED_HTML_MASQUERADE ENGINE_UNSUPPORTED_SITEMAP_FORMAT
classification error index-child UNSUPPORTED_FEED
classification info source ENCODING_CONFLICT ENCODING_BOM_DECLARATION_CONFLICT
decompression error source UNSUPPORTED_MALFORMED_GZIP DECOMPRESS_TOO_MANY_FILES
decompression error archive-member UNSUPPORTED_MALFORMED_ARCHIVE
decompression info archive-member DECOMPRESS_NOT_SITEMAP
schema error field SCHEMA_INVALID
schema warning document SCHEMA_UNKNOWN_NAMESPACE
protocol error document PROTOCOL_URL_COUNT_EXCEEDED PROTOCOL_SIZE_EXCEEDED PROTOCOL_NEWS_COUNT_EXCEEDED
protocol warning document PROTOCOL_LASTMOD_ALL_IDENTICAL HREFLANG_MISSING_SELF_REFERENCE HREFLANG_NON_RECIPROCAL HREFLANG_INCONSISTENT_LANGUAGE
protocol info document PROTOCOL_LASTMOD_LOOKS_GENERATED
protocol error entry PROTOCOL_PRIORITY_OUT_OF_RANGE PROTOCOL_CHANGEFREQ_INVALID PROTOCOL_LASTMOD_INVALID PROTOCOL_IMAGE_COUNT_EXCEEDED PROTOCOL_VIDEO_FIELD_INVALID PROTOCOL_NEWS_FIELD_INVALID PROTOCOL_URL_NOT_ABSOLUTE PROTOCOL_URL_NO_HOST PROTOCOL_URL_INVALID_ESCAPE PROTOCOL_URL_DECODED_TOO_LONG HREFLANG_FORMAT_INVALID HREFLANG_SEPARATOR_INVALID HREFLANG_XDEFAULT_INVALID HREFLANG_LINK_ATTR_INVALID
protocol warning entry PROTOCOL_URL_TOO_LONG PROTOCOL_URL_NOT_ESCAPED PROTOCOL_URL_OUT_OF_SCOPE PROTOCOL_DUPLICATE_LOC PROTOCOL_URL_EQUIVALENT PROTOCOL_TEXT_URL_TOO_LONG PROTOCOL_TAG_DATA_LIMIT_EXCEEDED HREFLANG_HREF_RELATIVE HREFLANG_DUPLICATE
protocol info entry PROTOCOL_LASTMOD_DATE_ONLY PROTOCOL_URL_FRAGMENT PROTOCOL_URL_USERINFO PROTOCOL_TEXT_BLANK_LINE HREFLANG_NONSTANDARD_CASE HREFLANG_XDEFAULT_MISSING
index-expansion error index-child INDEX_CYCLE_DETECTED INDEX_DEPTH_EXCEEDED INDEX_CHILD_COUNT_EXCEEDED INDEX_TOTAL_SITEMAPS_EXCEEDED INDEX_TOTAL_URLS_EXCEEDED
index-expansion warning index-child SITEMAP_INDEX_NESTED INDEX_CHILD_OUT_OF_SCOPE
page error page-url PAGE_FETCH_FAILED PAGE_SSRF_BLOCKED PAGE_STATUS_ERROR
page warning page-url PAGE_STATUS_REDIRECT PAGE_CANONICAL_MISMATCH PAGE_META_ROBOTS_NOINDEX PAGE_XROBOTSTAG_NOINDEX PAGE_HREFLANG_MISMATCH
page info page-url PAGE_REDIRECT_CHAIN PAGE_CANONICAL_MISSING
robots warning page-url ROBOTS_DISALLOWED
robots info page-url ROBOTS_INDETERMINATE
robots warning source ROBOTS_SITEMAP_DISALLOWED
"""
_STRICT_ONLY = {"PROTOCOL_LASTMOD_DATE_ONLY", "PROTOCOL_TEXT_BLANK_LINE", "HREFLANG_HREF_RELATIVE"}


@dataclass(frozen=True)
class Code:
    code: str
    layer: str
    severity: str
    subject_type: str
    is_strict_only: bool


REGISTRY: dict[str, Code] = {
    code: Code(code, layer, severity, subject, code in _STRICT_ONLY)
    for layer, severity, subject, *codes in (line.split() for line in _REGISTRY.strip().splitlines())
    for code in codes
}

_HINTS = {
    "PROTOCOL_DUPLICATE_LOC": "List each URL once.",
    "PROTOCOL_URL_EQUIVALENT": "Keep one spelling of the URL.",
    "PROTOCOL_URL_NOT_ESCAPED": "Percent-encode the URL.",
    "PROTOCOL_URL_NOT_ABSOLUTE": "Give the URL with its http or https scheme and host.",
    "PROTOCOL_URL_FRAGMENT": "Drop the part from the # on.",
    "PROTOCOL_URL_COUNT_EXCEEDED": "Split the sitemap and list the parts in an index.",
    "PROTOCOL_SIZE_EXCEEDED": "Split the sitemap and list the parts in an index.",
    "PROTOCOL_LASTMOD_INVALID": "Write a W3C date or a date-time with its zone.",
    "HREFLANG_NON_RECIPROCAL": "Link the alternates with one another.",
    "HREFLANG_MISSING_SELF_REFERENCE": "List the page among its own alternates.",
}


def hint(code: str) -> str | None:
    return _HINTS.get(code)


def columns(ddl: str) -> list[str]:
    """Names of the top-level columns of a schema."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out
