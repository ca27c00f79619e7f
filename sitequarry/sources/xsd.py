"""Schema check of sitemaps and their extensions: the public schemas' content models as tables.

Yields the elements that are wrong, each once: an element out of order or of a wrong value is blamed itself, for a missing child
its parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..schema import CHANGEFREQ
from .xmltree import CORE, IMAGE, NEWS, PAGEMAP, VIDEO, XHTML, XSI, Element, walk

KNOWN = {CORE, IMAGE, VIDEO, NEWS, PAGEMAP, XHTML}
Check = Callable[[str], bool]
_MANY = 10**9


def _collapse(s: str) -> str:
    return " ".join(s.split())


def _any(_: str) -> bool:
    return True


def _pattern(p: str, collapse: bool = False) -> Check:
    rx = re.compile(p)
    return lambda s: rx.fullmatch(_collapse(s) if collapse else s) is not None


def _one_of(*values: str) -> Check:
    return lambda s: s in values


def _most(n: int) -> Check:
    return lambda s: len(s) <= n


def _uri(least: int = 0, most: int = _MANY) -> Check:
    def check(s: str) -> bool:
        s = _collapse(s)
        if not re.match(r"[A-Za-z][\w+.\-]*:", s) and ":" in re.split("[/?#]", s)[0]:
            return False
        return least <= len(s) <= most and " " not in s and s.count("#") <= 1 and not re.search("%(?![0-9a-fA-F][0-9a-fA-F])", s)

    return check


def _number(lo: float, hi: float, pattern: str) -> Check:
    rx = re.compile(pattern)

    def check(s: str) -> bool:
        s = _collapse(s)
        return rx.fullmatch(s) is not None and lo <= float(s) <= hi

    return check


_DAY = re.compile(r"(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(?:\.\d+)?)?(?:Z|[+-](\d\d):(\d\d))?")


def _date(s: str) -> bool:
    m = _DAY.fullmatch(_collapse(s))
    if not m:
        return False
    year, month, day = int(m[1]), int(m[2]), int(m[3])
    days = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    clock = m[4] is None or (int(m[4]) < 24 and int(m[5]) < 60 and int(m[6]) < 60) or (m[4], m[5], m[6]) == ("24", "00", "00")
    return 1 <= month <= 12 and 1 <= day <= days[month - 1] and clock and (m[7] is None or (int(m[7]) * 60 + int(m[8]) <= 840 and int(m[8]) < 60))


_DECIMAL, _INTEGER = r"[+-]?(?:\d+\.?\d*|\.\d+)", r"[+-]?\d+"
_YES_NO = _one_of("yes", "Yes", "YES", "no", "No", "NO")
_SECONDS = _number(0, 28800, r"\+?\d+")
_COUNT = _number(0, float("inf"), r"\+?\d+")


class Type:
    """Text, attributes (name: (required, check)) and children ((name, type, least, most), in order; then any known element)."""

    def __init__(self, text: Check | None = None, attrs: dict[str, tuple[bool, Check]] | None = None, seq: list[tuple] | None = None, before: bool = False, after: bool = False):
        self.text, self.attrs, self.seq, self.before, self.after = text, attrs or {}, seq or [], before, after


def _leaf(check: Check = _any, **attrs: tuple[bool, Check]) -> Type:
    return Type(check, attrs)


def _opt(name: str, kind: Type | Check, most: int = 1) -> tuple:
    return name, kind if isinstance(kind, Type) else _leaf(kind), 0, most


def _req(name: str, kind: Type | Check, most: int = 1) -> tuple:
    return name, kind if isinstance(kind, Type) else _leaf(kind), 1, most


_RELATION = {"relationship": (True, _one_of("allow", "deny"))}
_LOC = _uri(12, 2048)
_PLATFORM, _TICKER = "(?:web|mobile|tv)", r"\w+:\w+"
_GENRES = "(PressRelease|Satire|Blog|OpEd|Opinion|UserGenerated)"
_URL = Type(seq=[_req("loc", _LOC), _opt("lastmod", _date), _opt("changefreq", _one_of(*CHANGEFREQ)), _opt("priority", _number(0, 1, _DECIMAL))], after=True)
_CHILD = Type(seq=[_req("loc", _LOC), _opt("lastmod", _date)], after=True)
_VIDEO = Type(
    seq=[
        _req("thumbnail_loc", _uri()), _req("title", _most(100)), _req("description", _most(2048)), _opt("content_loc", _uri()),
        _opt("player_loc", _leaf(_uri(), allow_embed=(False, _YES_NO), autoplay=(False, _any))), _opt("duration", _SECONDS), _opt("expiration_date", _date),
        _opt("rating", _number(0, 5, _DECIMAL)), _opt("content_segment_loc", _leaf(_uri(), duration=(False, _SECONDS)), _MANY), _opt("view_count", _COUNT),
        _opt("publication_date", _date), _opt("tag", _any, 32), _opt("category", _most(256)), _opt("family_friendly", _YES_NO),
        _opt("restriction", Type(_pattern("(?:[A-Z][A-Z](?: +[A-Z][A-Z])*)?"), _RELATION)), _opt("gallery_loc", _leaf(_uri(), title=(False, _any))),
        _opt("price", _leaf(_any, currency=(False, _pattern("[A-Z]{3}")), type=(False, _one_of("purchase", "PURCHASE", "rent", "RENT")), resolution=(False, _one_of("sd", "SD", "hd", "HD"))), _MANY),
        _opt("requires_subscription", _YES_NO), _opt("uploader", _leaf(_any, info=(False, _uri()))),
        _opt("tvshow", Type(seq=[
            _req("show_title", _any), _req("video_type", _one_of("full", "preview", "clip", "interview", "news", "other")), _opt("episode_title", _any),
            _opt("season_number", _number(1, float("inf"), _INTEGER)), _opt("episode_number", _number(1, float("inf"), _INTEGER)), _opt("premier_date", _date),
        ])),
        _opt("platform", Type(_pattern(f"(?:{_PLATFORM}(?: {_PLATFORM})*)?"), _RELATION)), _opt("live", _YES_NO),
        _opt("id", _leaf(_any, type=(True, _any)), _MANY),
    ]
)
_GLOBAL: dict[tuple[str, str], Type] = {
    (IMAGE, "image"): Type(seq=[_req("loc", _uri()), _opt("caption", _any), _opt("geo_location", _any), _opt("title", _any), _opt("license", _uri())]),
    (NEWS, "news"): Type(seq=[
        _req("publication", Type(seq=[_req("name", _any), _req("language", _pattern("[a-z]{2,3}|zh-(?:cn|tw)"))])), _opt("access", _one_of("Subscription", "Registration")),
        _opt("genres", _pattern(f"{_GENRES}(, *{_GENRES})*")), _req("publication_date", _date), _req("title", _any), _opt("keywords", _any),
        _opt("stock_tickers", _pattern(f"(?:{_TICKER}(?:, *{_TICKER}){{0,4}})?")),
    ]),
    (XHTML, "link"): Type(attrs={"rel": (True, _any), "href": (True, _uri()), "hreflang": (False, _any), "media": (False, _any)}),
    (PAGEMAP, "PageMap"): Type(seq=[
        _opt("Template", Type(attrs={"src": (True, _uri())})),
        _opt("DataObject", Type(attrs={"type": (True, _any), "id": (False, _any)}, seq=[_opt("Attribute", _leaf(_any, name=(True, _any), value=(False, _any)), _MANY)]), _MANY),
    ]),
    (VIDEO, "video"): _VIDEO,
}
_ROOT = {
    (CORE, "urlset"): Type(seq=[_req("url", _URL, _MANY)], before=True),
    (CORE, "sitemapindex"): Type(seq=[_req("sitemap", _CHILD, _MANY)], before=True),
}


def unknown_namespaces(root: Element) -> list[str]:
    """Namespaces that elements use and the catalog lacks."""
    return sorted({e.ns for e in walk(root) if e.ns and e.ns not in KNOWN})


def _check(e: Element, kind: Type) -> Iterator[tuple[Element, str]]:
    for name, (required, ok) in kind.attrs.items():
        if name in e.attrs:
            if not ok(e.attrs[name]):
                yield e, f"attribute {name} has a wrong value"
        elif required:
            yield e, f"attribute {name} is missing"
    for name in e.attrs:
        if name not in kind.attrs and not name.startswith(XSI + " "):
            yield e, f"attribute {name.rpartition(' ')[2]} is not allowed"
    if kind.text is not None:
        for c in e.children:
            yield c, "no child is allowed here"
        if not e.children and not kind.text(e.text):
            yield e, "the value is wrong"
        return
    if e.text.strip():
        yield e, "text is not allowed here"
    at, count, extended = 0, 0, False  # place in the sequence, elements there so far, whether the extensions have begun

    def lacks(upto: int) -> bool:
        return any(least > (count if i == at else 0) for i, (_, _, least, _) in enumerate(kind.seq[:upto]) if i >= at)

    for c in e.children:
        if c.ns and c.ns != e.ns:
            if kind.before and not at and not count:
                pass
            elif kind.after and not lacks(len(kind.seq)):
                extended = True
            else:
                yield c, "the element is not expected here"
                return
            if (c.ns, c.name) in _GLOBAL:
                yield from _check(c, _GLOBAL[c.ns, c.name])
            else:
                yield c, "the element is not declared"
            continue
        j = next((j for j in range(at, len(kind.seq)) if kind.seq[j][0] == c.name and (j > at or count < kind.seq[j][3])), None)
        if extended or c.ns != e.ns or j is None or lacks(j):
            yield c, "the element is not expected here"
            return
        at, count = j, count + 1 if j == at else 1
        yield from _check(c, kind.seq[j][1])
    if lacks(len(kind.seq)):
        yield e, "a child is missing"


def issues(root: Element) -> list[tuple[str, str, str, str]]:
    """(namespace, element, reason, excerpt) of what is wrong; one for each namespace and element."""
    kind = _ROOT.get((root.ns, root.name))
    found = [(root, "the element is not declared")] if kind is None else _check(root, kind)
    out: dict[tuple[str, str], tuple[str, str, str, str]] = {}
    for e, reason in found:
        out.setdefault((e.ns, e.name), (e.ns, e.name, reason, e.text.strip()[:200]))
    return list(out.values())
