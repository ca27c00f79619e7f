"""Literal guard against requests to where no sitemap can be: schemes, numeric hosts, private networks, metadata services."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import canonical

_METADATA = {"metadata", "metadata.google.internal", "metadata.goog", "instance-data", "instance-data.ec2.internal"}
_NAT64 = ipaddress.ip_network("64:ff9b::/96")
_COMPATIBLE = ipaddress.ip_network("::/96")
_TRANSLATED = ipaddress.ip_network("::ffff:0:0:0/96")
_SHARED = [ipaddress.ip_network(n) for n in ("100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "192.88.99.0/24", "240.0.0.0/4", "0.0.0.0/8")]


def blocked_address(host: str) -> str | None:
    """Why an IP literal is refused, or None."""
    try:
        ip = ipaddress.ip_address(host.strip("[]").split("%", 1)[0])
    except ValueError:
        return None
    inner = None
    if ip.version == 6:
        inner = ip.ipv4_mapped or ip.sixtofour or (ip.teredo or (None, None))[1]
        if inner is None and (ip in _NAT64 or ip in _TRANSLATED or (ip in _COMPATIBLE and int(ip) > 1)):
            inner = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
    for x in (ip, inner):
        if x is not None and (x.is_private or x.is_loopback or x.is_link_local or x.is_multicast or x.is_reserved or x.is_unspecified or (x.version == 4 and any(x in n for n in _SHARED))):
            if not (x is ip and inner is not None and ip in _NAT64):
                return "blocked-ip"
    return None


def check(url: str | None) -> str | None:
    """Why a URL must not be requested ('bad-url', 'bad-scheme', 'numeric-host', 'blocked-ip', 'blocked-host'), or None if it may."""
    parts = canonical(url) if url else None
    if not parts:
        return "bad-url"
    scheme, host = parts[0], parts[1].rstrip(".")
    if scheme not in ("http", "https"):
        return "bad-scheme"
    if host in _METADATA or host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return "blocked-host"
    if host.startswith("["):
        return blocked_address(host)
    if re.fullmatch(r"(?:0x[0-9a-f]*|\d+)(?:\.(?:0x[0-9a-f]*|\d+)){0,3}", host):  # also the octal, hex and short forms of addresses
        plain = re.fullmatch(r"(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}", host)
        return blocked_address(host) if plain else "numeric-host"
    return None


def blocked(url: Column) -> Column:
    """``check`` as a column."""

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(check)

    return F.pandas_udf(run, "string")(url)
