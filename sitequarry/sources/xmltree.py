"""A small namespace-aware XML tree over expat, and what sitemaps and feeds hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.parsers import expat

from .raw import SourceError

_GOOGLE, _W3 = "http://www.google.com/schemas/", "http://www.w3.org/"
CORE = "http://www.sitemaps.org/schemas/" + "sitemap/0.9"
IMAGE = _GOOGLE + "sitemap-image/1.1"
VIDEO = _GOOGLE + "sitemap-video/1.1"
NEWS = _GOOGLE + "sitemap-news/0.9"
PAGEMAP = _GOOGLE + "sitemap-pagemap/1.0"
XHTML = _W3 + "1999/xhtml"
XSI = _W3 + "2001/XMLSchema-instance"
_TRIM = " \t\r\n"


@dataclass(slots=True)
class Element:
    ns: str
    name: str
    attrs: dict[str, str]
    text: str = ""
    children: list[Element] = field(default_factory=list)

    def first(self, name: str) -> Element | None:
        return next((c for c in self.children if c.name == name), None)

    def value(self, name: str) -> str | None:
        c = self.first(name)
        return None if c is None else c.text.strip(_TRIM)

    def attr(self, name: str, attribute: str) -> str | None:
        c = self.first(name)
        return None if c is None else c.attrs.get(attribute)


@dataclass
class Document:
    root: Element
    entities: bool
    declared: str | None


def parse(data: bytes) -> Document:
    """The tree; malformed XML raises. Entities are never expanded, only noted."""
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        raise SourceError("xml_parse_error", "UTF-16 documents are not read.")
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True
    stack: list[Element] = []
    texts: list[list[str]] = []
    seen = Document(Element("", "", {}), False, None)

    def split(name: str) -> tuple[str, str]:
        ns, _, local = name.rpartition(" ")
        return ns, local

    def start(name: str, attrs: dict[str, str]) -> None:
        e = Element(*split(name), attrs)
        if stack:
            stack[-1].children.append(e)
        else:
            seen.root = e
        stack.append(e)
        texts.append([])

    def end(_: str) -> None:
        stack.pop().text = "".join(texts.pop())

    def chars(s: str) -> None:
        if texts:
            texts[-1].append(s)

    def entity(*_: object) -> None:
        seen.entities = True

    def declaration(_version: str, encoding: str | None, _alone: int) -> None:
        seen.declared = encoding

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    p.EntityDeclHandler, p.XmlDeclHandler, p.DefaultHandler = entity, declaration, lambda _: None
    try:
        p.Parse(data, True)
    except (expat.ExpatError, ValueError, LookupError) as e:
        raise SourceError("xml_parse_error", f"The XML cannot be parsed: {e}") from None
    return seen


def walk(e: Element):
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))


def _fields(e: Element, *names: str) -> dict:
    return {n: e.value(n) for n in names}


def _image(e: Element) -> dict:
    return _fields(e, "loc", "caption", "geo_location", "title", "license")


def _news(e: Element) -> dict:
    p = e.first("publication")
    return {"publication": _fields(p, "name", "language") if p else None} | _fields(e, "access", "genres", "publication_date", "title", "keywords", "stock_tickers")


def _video(e: Element) -> dict:
    return (
        _fields(
            e, "thumbnail_loc", "title", "description", "content_loc", "player_loc", "duration", "expiration_date", "rating", "view_count", "publication_date",
            "category", "family_friendly", "restriction", "gallery_loc", "requires_subscription", "uploader", "platform", "live",
        )
        | {"player_allow_embed": e.attr("player_loc", "allow_embed"), "player_autoplay": e.attr("player_loc", "autoplay"), "uploader_info": e.attr("uploader", "info")}
        | {"tags": [c.text.strip(_TRIM) for c in e.children if c.name == "tag"]}
        | {k: v for n in ("restriction", "platform") for k, v in ((f"has_{n}", e.first(n) is not None), (f"{n}_relationship", e.attr(n, "relationship")))}
    )


def entries(root: Element) -> list[dict]:
    """The ``url`` children in order; extensions only as direct children in their own namespace."""
    out = []
    for url in root.children:
        if url.name != "url":
            continue
        own = lambda ns, name, make, url=url: [make(c) for c in url.children if (c.ns, c.name) == (ns, name)]
        out.append(
            _fields(url, *"loc lastmod changefreq priority".split())
            | {
                "images": own(IMAGE, "image", _image),
                "video": own(VIDEO, "video", _video),
                "news": own(NEWS, "news", _news),
                "alternates": own(XHTML, "link", lambda c: {k: c.attrs.get(k) for k in ("rel", "hreflang", "href", "media")}),
            }
        )
    return out


def index_children(root: Element) -> list[dict]:
    return [_fields(c, "loc", "lastmod") for c in root.children if c.name == "sitemap"]


def feed_variant(root: Element) -> str | None:
    if root.name == "rss":
        return "rss2.0"
    return {"http://www.w3.org/2005/Atom": "atom1.0", "http://purl.org/atom/ns#": "atom0.3"}.get(root.ns) if root.name == "feed" else None


def feed_entries(root: Element) -> list[dict]:
    """RSS items and Atom entries as entries; another dialect raises."""
    variant = feed_variant(root)
    if variant is None:
        raise SourceError("unsupported_feed", f"The feed dialect of <{root.name}> is not supported.")
    out = []
    none = {"changefreq": None, "priority": None, "images": [], "video": [], "news": [], "alternates": []}
    if variant == "rss2.0":
        items = [i for c in root.children if c.name == "channel" for i in c.children if i.name == "item"]
        out = [{"loc": i.value("link"), "lastmod": i.value("pubDate")} | none for i in items]
    else:
        date = "updated" if variant == "atom1.0" else "modified"
        for e in root.children:
            if e.name == "entry":
                link = next((c for c in e.children if c.name == "link" and c.attrs.get("rel", "alternate") == "alternate"), None)
                out.append({"loc": link.attrs.get("href") if link else None, "lastmod": e.value(date)} | none)
    return [o for o in out if o["loc"]]
