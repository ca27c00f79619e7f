"""Bytes: format sniffing, gzip and tar."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class SourceError(Exception):
    """A failure of one source, with its class."""

    def __init__(self, error_class: str, message: str):
        super().__init__(message)
        self.error_class = error_class


_BLANK = re.compile(r"\s+")
_NS = r"(?:[a-z0-9_.\-]+:)?"
_ROOTS = [("xml-urlset", "urlset"), ("xml-sitemapindex", "sitemapindex"), ("feed", "(?:rss|feed)")]
_HTML = re.compile(rf"<(?:{'|'.join('a body div head html li meta ol p span table title ul'.split())})(?:[\s>/]|$)")
#: Comments, processing instructions and declarations (with an internal subset) before the root element.
_PROLOGUE = r"(?:\s+|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!(?!--)[^>\[]*\[[^\]]*\][^>]*>|<!(?!--)[^>\[]*>)*"


def sniff(data: bytes | None) -> str:
    """One of ``schema.FORMATS``."""
    if not data:
        return "empty"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[257:262] == b"ustar":
        return "tar"
    rest = data[3:] if data[:3] == b"\xef\xbb\xbf" else data[2:] if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data
    head = bytes(b for b in rest[:4096] if 9 <= b <= 0x7E).decode("ascii").lower().lstrip()
    if head.startswith("<"):
        root = head[re.match(_PROLOGUE, head).end() :]
        for name, pattern in _ROOTS:
            if re.match(f"<{_NS}{pattern}(?:[\\s>/]|$)", root):
                return name
        if head.startswith("<!doctype html") or _HTML.match(root):
            return "html"
        if re.match(rf"<{_NS}[a-z][a-z0-9_.\-]*(?:[\s>/]|$)", root):
            return "xml"
    sample = data[:4096]
    if 0 in sample:
        return "binary"
    control = sum((b < 0x20 and b not in (9, 10, 12, 13)) or b == 0x7F for b in sample)
    return "text" if control <= 0.1 * len(sample) else "binary"


def sniff_column(content: Column) -> Column:
    """``sniff`` as an expression, for routing documents inside the JVM."""
    size = F.octet_length(content)
    hexed = lambda start, n: F.hex(F.substring(content, start, n))
    skip = F.when(hexed(1, 3) == "EFBBBF", 3).when(hexed(1, 2).isin("FEFF", "FFFE"), 2).otherwise(0)
    head = F.decode(F.substring(content, skip + 1, F.lit(4096)), "ISO-8859-1")
    head = F.lower(F.regexp_replace(F.regexp_replace(head, "[^\x09-\x7e]", ""), r"^\s+", ""))
    root = F.regexp_replace(head, "^" + _PROLOGUE, "")
    sample = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    markup = head.startswith("<")
    out = F.when(content.isNull() | (size == 0), "empty").when(hexed(1, 2) == "1F8B", "gzip").when(hexed(258, 5) == "7573746172", "tar")
    for name, pattern in _ROOTS:
        out = out.when(markup & root.rlike(f"^<{_NS}{pattern}([\\s>/]|$)"), name)
    out = out.when(markup & (head.startswith("<!doctype html") | root.rlike("^" + _HTML.pattern)), "html")
    out = out.when(markup & root.rlike(rf"^<{_NS}[a-z][a-z0-9_.\-]*([\s>/]|$)"), "xml")
    out = out.when(sample.contains("\x00"), "binary")
    return out.when(F.length(F.regexp_replace(sample, "[^\x01-\x08\x0b\x0e-\x1f\x7f]", "")) <= 0.1 * F.length(sample), "text").otherwise("binary")


def gunzip(data: bytes, most: int = 500 << 20) -> bytes:
    """All members of a gzip stream; a corrupt or cut one raises, and one that inflates to more than ``most`` bytes, which is never held."""
    out, rest, left = [], data, most
    try:
        while rest:
            d = zlib.decompressobj(31)
            out.append(d.decompress(rest, left + 1))
            left -= len(out[-1])
            if left < 0:
                raise SourceError("malformed_gzip", f"The gzip stream inflates to more than {most} bytes.")
            if not d.eof:
                raise SourceError("malformed_gzip", "The gzip stream ends early.")
            rest = d.unused_data.lstrip(b"\0")
    except zlib.error as e:
        raise SourceError("malformed_gzip", f"The gzip stream is corrupt: {e}") from None
    return b"".join(out)


@dataclass(frozen=True)
class Member:
    name: str
    regular: bool
    content: bytes


def _field(header: bytes, at: int, size: int) -> str:
    return header[at : at + size].split(b"\0", 1)[0].decode("utf-8", "replace")


def tar_members(data: bytes) -> list[Member]:
    """Members of a ustar archive, directories and special files included."""
    out, at = [], 0
    while at < len(data):
        header = data[at : at + 512]
        if len(header) < 512:
            raise SourceError("malformed_archive", "A tar header is cut off.")
        at += 512
        if not any(header):
            break
        name, prefix = _field(header, 0, 100), _field(header, 345, 155)
        octal = _field(header, 124, 12).strip()
        if octal and not re.fullmatch("[0-7]+", octal):
            raise SourceError("malformed_archive", "A tar header has no octal size.")
        size = int(octal or "0", 8)
        if at + size > len(data):
            raise SourceError("malformed_archive", "A tar member is cut off.")
        out.append(Member(f"{prefix}/{name}" if prefix else name, header[156] in (0, 0x30), data[at : at + size]))
        at += -(-size // 512) * 512
    return out


def unsafe_name(name: str) -> bool:
    """An absolute name, one with a drive, or one that climbs."""
    return not name or bool(re.match(r"[/\\]|[A-Za-z]:", name)) or ".." in re.split(r"[/\\]", name)
