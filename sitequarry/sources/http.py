"""Fetching: request policy, redirects, retries, throttling. The transport is a plain callable, so that nothing here needs a network.

``fetch_documents`` partitions by host: an origin's requests stay in one task, which keeps throttling local and exact.
"""

from __future__ import annotations

import base64
import math
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import ssrf
from ..limits import FetchLimits
from ..operators.pages import ARTIFACT
from ..schema import FETCHED


@dataclass
class Response:
    status: int
    headers: dict[str, list[str]] = field(default_factory=dict)
    body: bytes = b""

    def header(self, name: str) -> str | None:
        return next((v[0] for k, v in self.headers.items() if k.lower() == name.lower() and v), None)


class TransportError(Exception):
    """No answer. ``kind``: 'timeout', 'connection', 'incomplete' or 'protocol'."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


#: (url, request headers, timeout, most bytes) -> Response, without following redirects; the body may be one byte over the limit.
Transport = Callable[[str, dict[str, str], float, int], Response]


@dataclass(frozen=True)
class Retry:
    max_tries: int = 1
    statuses: tuple[int, ...] = (429, 503)
    backoff_min: float = 1.0
    backoff_max: float = 60.0
    retry_on_failure: bool = False

    def __post_init__(self) -> None:
        if self.max_tries < 1 or not 0 < self.backoff_min <= self.backoff_max or not all(400 <= s <= 599 for s in self.statuses):
            raise ValueError("a retry needs max_tries >= 1, 0 < backoff_min <= backoff_max and statuses from 400 to 599")

    def wait(self, i: int, after: str | None) -> float:
        """Seconds before try i + 2: Retry-After within bounds, else a doubling backoff."""
        if after and after.strip().isdigit():
            return min(float(after), self.backoff_max)
        return min(self.backoff_min * 2**i, self.backoff_max)


@dataclass(frozen=True)
class Throttle:
    min_interval: float = 0.0
    requests: int | None = None
    window: float | None = None

    def __post_init__(self) -> None:
        if self.min_interval < 0 or (self.requests is None) != (self.window is None) or (self.requests is not None and (self.requests < 1 or self.window <= 0)):
            raise ValueError("a throttle needs min_interval >= 0, and requests with a window")


@dataclass(frozen=True)
class Proxy:
    url: str
    port: int | None = None
    username: str | None = None
    password: str | None = None


def basic_auth(username: str, password: str) -> str:
    return "Basic " + base64.b64encode(f"{username}:{password}".encode()).decode()


def bearer_auth(token: str) -> str:
    return f"Bearer {token}"


@dataclass(frozen=True)
class Policy:
    """How requests are made; pickled to the executors. ``prepare(url, headers) -> headers`` is the user's hook."""

    headers: tuple[tuple[str, str], ...] = ()
    auth: str | None = None
    proxy: Proxy | None = None
    verify_tls: bool = True
    retry: Retry = Retry()
    throttle: Throttle | None = None
    prepare: Callable[[str, dict[str, str]], dict[str, str]] | None = None
    user_agent: str = "sitequarry"
    ssrf_guard: bool = True

    def request_headers(self, url: str, first: bool = True) -> dict[str, str]:
        """Credentials go to the origin asked for only."""
        out = {"User-Agent": self.user_agent, **dict(self.headers)}
        if self.auth and first:
            out["Authorization"] = self.auth
        return self.prepare(url, out) if self.prepare else out


class Pacer:
    """Waits before requests of a host; the clock is injectable."""

    def __init__(self, throttle: Throttle | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.throttle, self.clock, self.sleep, self.past = throttle, clock, sleep, {}

    def before(self, url: str) -> None:
        if self.throttle is None:
            return
        host, t = urlsplit(url).netloc.lower(), self.throttle
        past = self.past.setdefault(host, [])
        wait = past[-1] + t.min_interval - self.clock() if past else 0
        if t.requests is not None and len(past) >= t.requests:
            wait = max(wait, past[-t.requests] + t.window - self.clock())
        if wait > 0:
            self.sleep(wait)
        past.append(self.clock())


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def _handlers(policy: Policy) -> list:
    out: list = [_NoRedirect]
    if policy.proxy:
        p = policy.proxy
        scheme, _, place = p.url.rpartition("://")
        user = f"{quote(p.username, safe='')}:{quote(p.password or '', safe='')}@" if p.username else ""
        at = f"{scheme or 'http'}://{user}{place.rstrip('/')}{f':{p.port}' if p.port else ''}"
        out.append(urllib.request.ProxyHandler({"http": at, "https": at}))
    if not policy.verify_tls:
        out.append(urllib.request.HTTPSHandler(context=ssl._create_unverified_context()))
    return out


def urllib_transport(url: str, headers: dict[str, str], timeout: float, most: int, policy: Policy = Policy()) -> Response:
    """The network, by the standard library; through the policy's proxy, and without a look at certificates if it says so."""
    opener = urllib.request.build_opener(*_handlers(policy))
    try:
        r = opener.open(urllib.request.Request(url, headers=headers), timeout=timeout)
    except urllib.error.HTTPError as e:
        r = e
    except TimeoutError as e:
        raise TransportError("timeout", str(e)) from None
    except (urllib.error.URLError, OSError) as e:
        raise TransportError("timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "connection", str(e)) from None
    names: dict[str, list[str]] = {}
    for k, v in r.headers.items():
        names.setdefault(k, []).append(v)
    try:
        return Response(r.status, names, r.read(most + 1))
    except OSError as e:
        raise TransportError("incomplete", str(e)) from None


@dataclass
class Fetched:
    requested: str
    final: str
    outcome: str
    status: int | None = None
    headers: dict[str, list[str]] = field(default_factory=dict)
    body: bytes | None = None
    truncated: bool = False
    hops: list[dict] = field(default_factory=list)
    seconds: float = 0.0


def fetch(url: str, transport: Transport, policy: Policy = Policy(), limits: FetchLimits = FetchLimits(), *, cap: int | None = None, no_downgrade: bool = False, scheme_inferred: bool = False, pacer: Pacer | None = None) -> Fetched:
    """One URL with its redirects, each hop guarded. ``cap`` cuts the body there (a page); without it a longer body than the limit is
    an outcome of its own. ``no_downgrade`` refuses https to http. An inferred https scheme is tried again as http when nothing answers."""
    pacer, began = pacer or Pacer(policy.throttle), time.monotonic()
    now, hops, most = url, [], cap if cap is not None else limits.max_bytes
    while True:
        if policy.ssrf_guard and ssrf.check(now):
            return Fetched(url, now, "safety_refused", hops=hops, seconds=time.monotonic() - began)
        same = urlsplit(now).netloc == urlsplit(url).netloc
        for i in range(policy.retry.max_tries):
            pacer.before(now)
            try:
                how = {"policy": policy} if transport is urllib_transport else {}
                r = transport(now, policy.request_headers(now, same), limits.timeout, most, **how)
            except TransportError as e:
                if i + 1 < policy.retry.max_tries and policy.retry.retry_on_failure:
                    pacer.sleep(policy.retry.wait(i, None))
                    continue
                if scheme_inferred and not hops and now.startswith("https://"):
                    return fetch("http://" + now[8:], transport, policy, limits, cap=cap, no_downgrade=no_downgrade, pacer=pacer)
                kind = {"timeout": "timeout", "incomplete": "incomplete", "protocol": "http_protocol_error"}.get(e.kind, "transport_fail")
                return Fetched(url, now, kind, hops=hops, seconds=time.monotonic() - began)
            if r.status in policy.retry.statuses and i + 1 < policy.retry.max_tries:
                pacer.sleep(policy.retry.wait(i, r.header("Retry-After")))
                continue
            break
        target = r.header("Location") if r.status in (301, 302, 303, 307, 308) else None
        if target is None:
            done = Fetched(url, now, "usable_body", r.status, r.headers, r.body, hops=hops, seconds=time.monotonic() - began)
            if len(r.body) > most:
                done.body, done.truncated = (r.body[:most], True) if cap is not None else (None, True)
                done.outcome = "partial" if cap is not None else "body_ceiling"
            if not 200 <= r.status <= 299:
                done.outcome = "http_status"
            return done
        hops.append({"url": now, "status": r.status, "location": target})
        if len(hops) > limits.max_redirects:
            return Fetched(url, now, "redirect_over_budget", r.status, hops=hops, seconds=time.monotonic() - began)
        new = urljoin(now, target)
        if no_downgrade and now.startswith("https:") and new.startswith("http:"):
            return Fetched(url, new, "safety_refused", r.status, hops=hops, seconds=time.monotonic() - began)
        now = new


_ERRORS = {"timeout": "timeout", "transport_fail": "timeout", "incomplete": "fetch", "http_protocol_error": "fetch", "safety_refused": "ssrf", "redirect_over_budget": "redirects", "body_ceiling": "body_ceiling"}


def document_row(f: Fetched) -> dict:
    """A fetched source as ``schema.FETCHED``; an answer outside 2xx has no body to parse but is no failure of transport."""
    return {
        "doc_id": f.requested, "requested_url": f.requested, "final_url": f.final, "path": None, "content": f.body, "byte_size": len(f.body or b""), "status": f.status,
        "content_type": next((v[0] for k, v in f.headers.items() if k.lower() == "content-type" and v), None), "fetched_at": None,
        "error_class": _ERRORS.get(f.outcome) or ("http_error" if f.outcome == "http_status" else None),
        "redirect_chain": [*(h["url"] for h in f.hops), f.final], "timing": f.seconds,
    }


def fetch_documents(urls: DataFrame, transport: Transport, policy: Policy = Policy(), limits: FetchLimits = FetchLimits()) -> DataFrame:
    """``urls`` (url, optionally scheme_inferred) as documents."""
    arrow = to_arrow_schema(_parse_datatype_string(FETCHED))
    inferred = F.col("scheme_inferred") if "scheme_inferred" in urls.columns else F.lit(False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer(policy.throttle)
        for b in batches:
            for u, s in zip(b.column("url").to_pylist(), b.column("inferred").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([document_row(fetch(u, transport, policy, limits, scheme_inferred=bool(s), pacer=pacer))], schema=arrow)

    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    return urls.select("url", inferred.alias("inferred")).repartition(host).mapInArrow(run, FETCHED)


def fetch_pages(pages: DataFrame, transport: Transport, policy: Policy = Policy(), limits: FetchLimits = FetchLimits(), *, cap: int = 1 << 20, deadline: float = math.inf) -> DataFrame:
    """``pages`` (loc) as ``operators.pages.ARTIFACT``. Pages whose turn comes after ``deadline`` (of ``time.time``) are skipped."""
    arrow = to_arrow_schema(_parse_datatype_string(ARTIFACT))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer(policy.throttle)
        for b in batches:
            for u in b.column("loc").to_pylist():
                if time.time() >= deadline:
                    skipped = {"loc": u, "requested_url": u, "final_url": u, "status": None, "hops": [], "headers": [], "body": None, "truncated": False, "outcome": "skipped"}
                    yield pa.RecordBatch.from_pylist([skipped], schema=arrow)
                    continue
                f = fetch(u, transport, policy, limits, cap=cap, no_downgrade=True, pacer=pacer)
                outcome = "transport_fail" if f.outcome == "timeout" else f.outcome
                row = {"loc": u, "requested_url": u, "final_url": f.final, "status": f.status, "hops": f.hops, "headers": list(f.headers.items()), "body": f.body, "truncated": f.truncated, "outcome": outcome}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return pages.select("loc").repartition(F.regexp_extract("loc", r"^[a-zA-Z]+://([^/?#]*)", 1)).mapInArrow(run, ARTIFACT)
