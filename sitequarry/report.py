"""The report sink: one self-contained HTML page. Aggregates are made in Spark; only what is shown reaches the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import functions as F

from .api import Audit
from .operators import report as R

URL_ROWS, TREE_URLS = 1000, 10_000
_CSS = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}.bar{background:#69c;height:1em}h2{margin-top:2em}"


def _table(head: list[str], rows: list[tuple]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in row)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def _folders(rows: list[tuple[str, int, int]]) -> str:
    children: dict[str, list[tuple[str, int]]] = {}
    for prefix, depth, n in rows:
        if depth:
            children.setdefault(prefix.rpartition("/")[0], []).append((prefix, n))

    def node(prefix: str) -> str:
        out = []
        for p, n in sorted(children.get(prefix, []), key=lambda x: (-x[1], x[0])):
            label, inner = f"/{escape(p.rpartition('/')[2])} ({n})", node(p)
            out.append(f"<details><summary>{label}</summary>{inner}</details>" if inner else f"<div>{label}</div>")
        return f"<div style='margin-left:16px'>{''.join(out)}</div>" if out else ""

    return node("")


def render(audit: Audit, title: str = "Sitemap report") -> str:
    severities = R.severity_counts(audit.findings).first()
    cover = R.lastmod_coverage(audit.urls).first()
    months = R.lastmod_histogram(audit.urls).orderBy("month").collect()
    most = max((m.n for m in months), default=1)
    bars = "".join(f"<tr><td>{escape(m.month)}</td><td style='width:30em'><div class='bar' style='width:{100 * m.n / most:.0f}%'></div></td><td>{m.n}</td></tr>" for m in months)
    samples = R.finding_samples(audit.findings).collect()
    shown = audit.urls.select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "changefreq", "priority", "source_sitemap").limit(URL_ROWS).collect()
    parts = [
        f"<h1>{escape(title)}</h1><p>{cover.n} URLs, {cover.percent} % with a lastmod</p>",
        "<h2>Findings</h2>" + _table(["fatal", "error", "warning", "info"], [tuple(severities)]) + _table(["layer", "code", "severity", "count", "first", "message"], [tuple(s) for s in samples]),
        "<h2>Sources</h2>" + _table(["format", "count"], [tuple(r) for r in R.format_counts(audit.sources).orderBy("format").collect()]) + _table(["sitemap", "URLs", "lastmod", "priority", "changefreq"], [tuple(r) for r in R.source_counts(audit.urls).orderBy("source_sitemap").limit(URL_ROWS).collect()]),
        f"<h2>lastmod by month</h2><table>{bars}</table>",
        "<h2>Folders</h2>" + _folders([tuple(r) for r in R.folder_tree(audit.urls.limit(TREE_URLS)).collect()]),
        f"<h2>URLs (first {URL_ROWS})</h2>" + _table("loc lastmod changefreq priority sitemap".split(), [tuple(r) for r in shown]),
    ]
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_CSS}</style></head><body>{''.join(parts)}</body></html>"


def report(audit: Audit, path: str | None = None, title: str = "Sitemap report") -> str:
    """The page, also written to ``path`` if given."""
    page = render(audit, title)
    if path is not None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(page)
    return page
