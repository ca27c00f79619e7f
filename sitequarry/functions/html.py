"""Facts of fetched pages: one parse of the body gives canonicals, robots directives and alternates."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from ..rulesets import CRAWLERS
from .urls import canonical, loc_key

FACTS = (
    "canonicals array<string>, canonical_keys array<string>, alternates array<string>, alternates_self boolean, "
    "directives array<struct<channel:string,scope:string,raw:string,tokens:array<string>>>"
)
_KNOWN = {c for names in CRAWLERS.values() for c in names}


def resolve(href: str | None, base: str | None) -> str | None:
    """The absolute URL of a reference, or null if it is blank or cannot be resolved."""
    href = (href or "").strip()
    if not href:
        return None
    try:
        return urljoin(base or "", href) or None
    except ValueError:
        return None


class _Head(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.links: list[dict[str, str]] = []
        self.metas: list[dict[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("base", "link", "meta"):
            own = {}
            for k, v in attrs:
                own.setdefault(k, v or "")
            if tag == "base":
                self.base = self.base or own.get("href")
            elif tag == "link":
                self.links.append(own)
            else:
                self.metas.append(own)


def tokens(value: str) -> list[str]:
    return [t for p in value.split(",") if (t := p.strip().lower())]


def alternate_keys(links: list[tuple[str | None, str | None]], base: str | None) -> list[str]:
    """'token<tab>key' of each (hreflang, href), sorted, each once."""
    out = set()
    for tag, href in links:
        url = resolve(href, base)
        if (tag or "").strip() and url:
            out.add(f"{tag.strip().lower()}\t{loc_key(url)}")
    return sorted(out)


def _header_values(headers: dict[str, list[str]] | None, name: str) -> list[str]:
    return [v for k, vs in (headers or {}).items() if k.lower() == name for v in vs or [] if v]


def page_facts(body: bytes | None, headers: dict[str, list[str]] | None, final_url: str | None) -> dict:
    """``FACTS`` of a page. Broken markup gives what can be read."""
    head = _Head()
    try:
        head.feed(bytes(body or b"").decode("utf-8", "replace"))
        head.close()
    except (ValueError, AssertionError):
        pass
    base = resolve(head.base, final_url) or final_url
    found = [resolve(a.get("href"), base) for a in head.links if "href" in a and "canonical" in a.get("rel", "").lower().split()]
    link = ", ".join(_header_values(headers, "link"))
    for part in re.split(r",(?=\s*<)", link):
        m = re.match(r"\s*<([^>]*)>([\s\S]*)", part)
        if m and re.search(r'rel\s*=\s*"?canonical"?', m[2], re.IGNORECASE):
            found.append(resolve(m[1], final_url))
    targets = list(dict.fromkeys(u for u in found if u))
    directives = []
    for a in head.metas:
        name = a.get("name", "").strip().lower()
        if "content" in a and (name == "robots" or name in _KNOWN):
            directives.append({"channel": "meta", "scope": "*" if name == "robots" else name, "raw": a["content"], "tokens": tokens(a["content"])})
    for value in _header_values(headers, "x-robots-tag"):
        m = re.match(r"\s*([^:,]+)\s*:\s*(.*)$", value, re.DOTALL)
        scope, rest = (m[1].strip().lower(), m[2]) if m and m[1].strip().lower() in _KNOWN else ("*", value)
        if own := tokens(rest):
            directives.append({"channel": "header", "scope": scope, "raw": value, "tokens": own})
    links = [(a.get("hreflang"), a.get("href")) for a in head.links if {"rel", "href", "hreflang"} <= a.keys() and a["rel"].strip().lower() == "alternate"]
    alternates = alternate_keys(links, base)
    own_key = loc_key(final_url) if final_url and canonical(final_url) else None
    return {
        "canonicals": targets,
        "canonical_keys": sorted({loc_key(u) for u in targets}),
        "alternates": alternates,
        "alternates_self": any(a.split("\t", 1)[1] == own_key for a in alternates),
        "directives": directives,
    }
