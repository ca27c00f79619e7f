"""Field values of sitemap entries: dates, priorities, excerpts, hreflang tokens, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import trim4

_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse_lastmod(raw: Column) -> Column:
    """A date at midnight UTC, or a date-time that has seconds and a zone; anything else is null."""
    x = trim4(raw)
    zoned = F.regexp_replace(x, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(x.rlike(_DATE), F.try_to_timestamp(F.concat(x, F.lit("T00:00:00Z")))).when(x.rlike(_TIME), F.try_to_timestamp(zoned))


def lastmod_class(raw: Column) -> Column:
    """'absent', 'date-only', 'datetime' or 'invalid'."""
    x, t = trim4(raw), parse_lastmod(raw)
    return F.when(raw.isNull() | (x == ""), "absent").when(t.isNull(), "invalid").when(x.rlike(_DATE), "date-only").otherwise("datetime")


def parse_priority(raw: Column) -> Column:
    return trim4(raw).try_cast("double")


def excerpt(text: Column, chars: int = 500) -> Column:
    return F.substring(text, 1, chars)


def hreflang_code(raw: Column) -> Column:
    """The finding a language token gives, or null: a well-formed token or an exact x-default."""
    t = trim4(raw)
    n = F.size(F.split(t, "-"))
    one = (n == 1) & t.rlike("^[A-Za-z]{2}$") & (t != F.upper(t))
    two = (n == 2) & t.rlike("^[A-Za-z]{2}-([A-Za-z]{2}|[A-Za-z]{4})$")
    three = (n == 3) & t.rlike("^[A-Za-z]{2}-[A-Za-z]{4}-[A-Za-z]{2}$")
    usual = t.rlike("^[a-z]{2}(-[A-Z][a-z]{3})?(-[A-Z]{2})?$")
    return (
        F.when(raw.isNull(), None)
        .when(F.lower(F.translate(t, "_", "-")) == "x-default", F.when(raw == "x-default", None).otherwise("HREFLANG_XDEFAULT_INVALID"))
        .when((t == "") | (t != raw), "HREFLANG_FORMAT_INVALID")
        .when(t.contains("_") | t.contains("--") | t.startswith("-") | t.endswith("-") | t.rlike(r"\s"), "HREFLANG_SEPARATOR_INVALID")
        .when(~(one | two | three), "HREFLANG_FORMAT_INVALID")
        .when(~usual, "HREFLANG_NONSTANDARD_CASE")
    )


def norm_encoding(label: Column) -> Column:
    """An encoding's label in lower case, letters and digits only; null if nothing is left of it."""
    return F.nullif(F.regexp_replace(F.lower(trim4(label)), "[^a-z0-9]", ""), F.lit(""))


def resolve_encoding(bom: Column, declared: Column, http: Column) -> Column:
    return F.coalesce(norm_encoding(bom), norm_encoding(declared), norm_encoding(http), F.lit("utf8"))
