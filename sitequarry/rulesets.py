"""Engine rulesets: revisions, submission context, and what engines document about single codes."""

from __future__ import annotations

from dataclasses import dataclass, field

RULESETS = tuple("sitemaps.org google bing yandex".split())
REVISIONS = dict.fromkeys(RULESETS, "2026-07-16")
CHANNELS = tuple("absent search_console_api webmaster_tools user import".split())
PROVENANCES = tuple("organic robots_txt_reference supplied guessed_path index_child archive_derived".split())
EVIDENCE = tuple("absent verified_property_set target_host_robots_reference same_location_default conflicting".split())

_LIMITS = ("PROTOCOL_URL_COUNT_EXCEEDED", "INDEX_CHILD_COUNT_EXCEEDED", "PROTOCOL_SIZE_EXCEEDED")
_FIELDS = ("PROTOCOL_LASTMOD_INVALID", "PROTOCOL_CHANGEFREQ_INVALID", "PROTOCOL_PRIORITY_OUT_OF_RANGE")
_SCOPE = ("PROTOCOL_URL_OUT_OF_SCOPE", "INDEX_CHILD_OUT_OF_SCOPE")
PROVENANCE: dict[str, dict[str, str]] = {
    "google": dict.fromkeys(_LIMITS + _SCOPE, "documented"),
    "bing": dict.fromkeys(_LIMITS, "documented"),
    "yandex": dict.fromkeys(_LIMITS + _SCOPE + _FIELDS + ("ENGINE_UNSUPPORTED_SITEMAP_FORMAT",), "documented")
    | {"PROTOCOL_URL_DECODED_TOO_LONG": "application_choice", "PROTOCOL_TAG_DATA_LIMIT_EXCEEDED": "advisory"},
}
SEVERITY: dict[str, dict[str, str]] = {"yandex": dict.fromkeys(_FIELDS, "warning")}
#: Crawlers whose robots directives an engine obeys, besides those for all.
CRAWLERS = {e: tuple(names.split()) for e, names in {"google": "googlebot googlebot-news googlebot-image google", "bing": "bingbot msnbot bing", "yandex": "yandexbot yandex"}.items()}
FEEDS = ("rss2.0", "atom1.0", "atom0.3")


def format_support(variant: str, engine: str | None) -> str:
    """Whether an engine takes a feed dialect: 'supported', 'unsupported' or 'not_documented'."""
    if engine == "yandex":
        return "unsupported"
    return "not_documented" if (engine, variant) == ("google", "atom0.3") else "supported"


@dataclass(frozen=True)
class Context:
    submission_channel: str = "absent"
    discovery_provenance: str = "organic"
    property_scope: str | None = None
    authority_evidence: str = "absent"

    def __post_init__(self) -> None:
        for value, allowed in ((self.submission_channel, CHANNELS), (self.discovery_provenance, PROVENANCES), (self.authority_evidence, EVIDENCE)):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")


@dataclass(frozen=True)
class Ruleset:
    name: str
    context: Context = field(default_factory=Context)

    def __post_init__(self) -> None:
        if self.name not in RULESETS:
            raise ValueError(f"{self.name!r} is not one of {RULESETS}")

    @property
    def revision(self) -> str:
        return REVISIONS[self.name]

    @property
    def engine(self) -> str | None:
        return self.name if self.name in CRAWLERS else None

    def context_items(self) -> list[tuple[str, str | None]]:
        c = self.context
        return [("submission_channel", c.submission_channel), ("discovery_provenance", c.discovery_provenance), ("property_scope", c.property_scope), ("authority_evidence", c.authority_evidence)]

    @property
    def authority_established(self) -> bool:
        c = self.context
        if self.name == "google":
            return (c.submission_channel == "search_console_api" and c.authority_evidence == "verified_property_set") or c.authority_evidence == "target_host_robots_reference"
        return self.name == "sitemaps.org" and c.authority_evidence in ("target_host_robots_reference", "same_location_default")


def gsc_submission(prop: str) -> Context:
    """Submitted through Search Console by the owner of a verified property."""
    return Context("search_console_api", "organic", prop, "verified_property_set")


def robots_cross_submission() -> Context:
    """Named by the target host's robots.txt."""
    return Context("absent", "robots_txt_reference", None, "target_host_robots_reference")


def context_for_child(submission_channel: str = "absent", property_scope: str | None = None, authority_evidence: str = "absent") -> Context:
    """The context of an index's child."""
    return Context(submission_channel, "index_child", property_scope, authority_evidence)
