"""URL functions: predicates, splitting, canonical form and the identity key, as columns.

Plain ASCII URLs are split by regular expressions inside the JVM. Only URLs that may need work (non-ASCII, escapes, userinfo,
dot segments ...) reach the Arrow function, which gets null for all others.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import idna
except ImportError:  # the standard codec knows the 2003 rules
    idna = None

PARTS = "struct<scheme:string,host:string,port:int,path:string,query:string,fragment:string,user:string,key:string>"
_SCHEME = r"[A-Za-z][\w+.\-]*"
_SPLIT = rf"^({_SCHEME})://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_BAD_ESCAPE = "%(?![0-9a-fA-F][0-9a-fA-F])"
_PLAIN_SPLIT = r"^([A-Za-z]+)://([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_PLAIN = (
    r"(?i)^https?://(?:[a-z0-9-]+\.)*[a-z0-9-]*[a-z][a-z0-9-]*\.?(?::[0-9]{1,5})?"
    r"(?:/(?!/)(?!\.{1,2}(?:/|$|[?#]))[a-z0-9._~-]*)*(?:\?[a-z0-9._~&=/?-]+)?(?:#[a-z0-9._~:/?#&=-]*)?$"
)


def absoluteness(loc: Column) -> Column:
    """'http(s)', 'other-scheme' or 'relative'."""
    return F.when(loc.rlike("(?i)^https?://"), "http(s)").when(loc.rlike(f"^{_SCHEME}:"), "other-scheme").otherwise("relative")


def invalid_escape(loc: Column) -> Column:
    return loc.rlike(_BAD_ESCAPE)


def illegal_char(loc: Column) -> Column:
    """A character that neither a URI nor an IRI may hold unescaped."""
    return loc.rlike(r'[ "<>\\^`{|}\x01-\x1f\x7f]')


def non_ascii(loc: Column) -> Column:
    return F.octet_length(loc) > F.char_length(loc)


def decoded_length(loc: Column) -> Column:
    """Characters after percent-decoding ('+' stays); those of the raw text if it cannot be decoded."""
    return F.char_length(F.coalesce(F.try_url_decode(F.replace(loc, F.lit("+"), F.lit("%2B"))), loc))


def _drop_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == ".":
            if last:
                out.append("")
        elif p == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def _encode(text: str) -> str:
    """Percent-encodes what a URI may not hold; what is encoded already stays."""
    return quote(re.sub(_BAD_ESCAPE, "%25", text), safe="%/:?#[]@!$&'()*+,;=~-._", errors="replace")


@lru_cache(maxsize=50_000)
def canonical(url: str) -> tuple | None:
    """(scheme, host, port, path, query, fragment, user) of a URL; None unless it has a scheme, '//' and a host."""
    m = re.match(_SPLIT, url.strip())
    if not m:
        return None
    scheme, authority, path, query, fragment = m.groups()
    user, _, hostport = authority.rpartition("@")
    user = user.split(":", 1)[0]
    m = re.match(r"^(\[[^\]]*\]|[^:]*)(?::(\d*))?$", hostport)
    if not m or not m[1]:
        return None
    host, port = m[1].lower(), int(m[2]) if m[2] else None
    if not host.isascii():
        try:
            host = idna.encode(host, uts46=True).decode() if idna else host.encode("idna").decode()
        except (UnicodeError, ValueError):
            pass
    path = re.sub("/{2,}", "/", _drop_dots(re.sub("/{2,}", "/", path))) or "/"
    query = query[1:] if query else None
    return scheme.lower(), host, port, _encode(path), _encode(query) if query else None, fragment[1:] or None if fragment else None, user or None


def _slow(urls: pd.Series) -> pd.DataFrame:
    rows = [None if u is None else canonical(u) for u in urls]
    out = pd.DataFrame([r or (None,) * 7 for r in rows], columns="scheme host port path query fragment user".split(), dtype=object)
    out["port"] = out["port"].astype("Int32")
    out["key"] = [loc_key(u) if r else None for u, r in zip(urls, rows, strict=True)]
    return out


def _pieces(url: Column) -> Column:
    """[scheme, host, port, path, ?query, #fragment] of a plain URL, '' for what is missing; null for any other URL."""
    return F.when(url.rlike(_PLAIN), F.split(F.regexp_replace(url, _PLAIN_SPLIT, "$1\x01$2\x01$3\x01$4\x01$5\x01$6"), "\x01"))


def _plain_parts(p: Column) -> Column:
    scheme, host, port, query = F.lower(p[0]), F.lower(p[1]), p[2], p[4]
    path = F.when(p[3] == "", "/").otherwise(p[3])
    own = (port == "") | ((scheme == "http") & port.rlike("^0*80$")) | ((scheme == "https") & port.rlike("^0*443$"))
    rest = lambda x: F.when(F.length(x) > 1, F.substring(x, 2, 2**31 - 1))
    return F.when(
        p.isNotNull(),
        F.struct(
            scheme.alias("scheme"),
            host.alias("host"),
            F.when(port != "", port.cast("int")).alias("port"),
            path.alias("path"),
            rest(query).alias("query"),
            rest(p[5]).alias("fragment"),
            F.lit(None).cast("string").alias("user"),
            F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port.cast("int").cast("string"))), path, query).alias("key"),
        ),
    )


def port_part(url: Column) -> Column:
    """':port', or '' if there is none or it is the scheme's own."""
    own = ((url["scheme"] == "http") & (url["port"] == 80)) | ((url["scheme"] == "https") & (url["port"] == 443))
    return F.when(url["port"].isNull() | own, "").otherwise(F.concat(F.lit(":"), url["port"].cast("string")))


def authority(url: Column) -> Column:
    return F.concat(url["scheme"], F.lit("://"), url["host"], port_part(url))


def with_url(df: DataFrame, loc: str = "loc", url: str = "url", out: str = "loc_key") -> DataFrame:
    """Adds the components as ``url`` and the identity key as ``out``.

    What plain URLs need is computed below the Arrow function, where the plan keeps it as columns; above it nothing is computed twice.
    """
    x = F.col(loc)
    df = df.withColumn("__p", _pieces(x)).withColumn(url, _plain_parts(F.col("__p"))).drop("__p")
    fixed = F.pandas_udf(_slow, PARTS).asNondeterministic()  # else filters on the result go below it, with a second copy of everything
    slow = fixed(F.when(F.col(url).isNull() & (absoluteness(x) == "http(s)"), x))
    df = df.withColumn("__slow", slow)
    return df.withColumn(url, F.coalesce(F.col(url), F.when(F.col("__slow.host").isNotNull(), F.col("__slow")))).drop("__slow").withColumn(out, F.coalesce(F.col(f"{url}.key"), x))


def loc_key(url: str | None) -> str | None:
    """The identity key of one URL, on the driver or in a Python function."""
    if url is None or not (p := canonical(url)):
        return url
    scheme, host, port, path, query, _, user = p
    own = (scheme, port) in (("http", 80), ("https", 443))
    return f"{scheme}://{user + '@' if user else ''}{host}{'' if port is None or own else f':{port}'}{path}{'?' + query if query else ''}"


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("/")), "[^/]*$", "")


def base_ref(url: Column) -> Column:
    """Subject reference of a sitemap: its URL or path without the scheme."""
    return F.concat(F.lit("sitemap://"), F.regexp_replace(url, f"^{_SCHEME}://", ""))


def trim4(x: Column) -> Column:
    """Without blanks, tabs and line ends at both ends."""
    return F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
