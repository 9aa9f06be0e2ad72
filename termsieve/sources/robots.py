"""robots.txt: the groups that apply, and whether a path may be fetched (longest match, allow on ties)."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "termsieve"


def fields(text: str):
    """(name, value) of each directive, lower-case names, comments gone."""
    for raw in text.lstrip("﻿").splitlines():
        name, colon, value = raw.partition("#")[0].partition(":")
        if colon:
            yield name.strip().lower(), value.strip()


def groups(text: str) -> list[dict]:
    """Groups in order: agents (consecutive agent lines share one) and their rules."""
    out: list[dict] = []
    fresh = False
    for name, value in fields(text):
        if name == "user-agent":
            if not fresh:
                out.append({"agents": [], "rules": []})
            out[-1]["agents"].append(value)
        elif out and name in ("allow", "disallow", "crawl-delay"):
            out[-1]["rules"].append((name, value))
        fresh = name == "user-agent"
    return out


def applying(text: str, token: str = TOKEN) -> list[dict]:
    """The token's own groups, or else those of everyone."""
    some = groups(text)
    by = lambda want: [g for g in some if want in (a.lower() for a in g["agents"])]
    return by(token.lower()) or by("*")


def _plain(path: str) -> str:
    return quote(unquote(path), safe="/?&=:;@!$'()*+,~-._")


@lru_cache(maxsize=4096)
def _pattern(rule: str) -> re.Pattern:
    body = ".*".join(re.escape(_plain(p)) for p in rule.removesuffix("$").split("*"))
    return re.compile(body + ("$" if rule.endswith("$") else ""))


def can_fetch(text: str, url: str, token: str = TOKEN) -> bool:
    parts = urlsplit(url)
    path = _plain(parts.path or "/") + (f"?{_plain(parts.query)}" if parts.query else "")
    best = (-1, True)
    for g in applying(text, token):
        for name, rule in g["rules"]:
            if name != "crawl-delay" and rule and _pattern(rule).match(path):
                best = max(best, (len(rule), name == "allow"))
    return best[1]


def crawl_delay(text: str, token: str = TOKEN) -> float | None:
    for g in applying(text, token):
        for name, value in g["rules"]:
            if name == "crawl-delay":
                try:
                    return float(value)
                except ValueError:
                    return None
    return None


def sitemaps(text: str) -> list[str]:
    return [v for n, v in fields(text) if n == "sitemap" and v]


def state(status: int | None, error: str | None) -> str:
    """read, none (no restrictions) or unavailable (treated as not allowed)."""
    if error or status is None or status >= 500 or status in (401, 403):
        return "unavailable"
    return "read" if 200 <= status < 300 else "none"


def with_allowed(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Adds `allowed` by the robots text of each URL's host; robots: (host, robots), one row a host.

    Hosts without a row have no restrictions. The texts are joined by host and shipped once per row
    batch; where a host is very frequent Spark's skew join splits it.
    """
    from ..functions.web import host

    kept = urls.columns
    names = [*kept, "allowed"]

    def run(batches):
        for batch in batches:
            ok = [text is None or u is None or can_fetch(text, u) for u, text in zip(batch.column(url).to_pylist(), batch.column("robots").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ok, pa.bool_())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields) + ", allowed boolean"
    joined = urls.withColumn("host", host(F.col(url))).join(robots.select("host", "robots"), "host", "left") if "host" not in urls.columns else urls.join(robots.select("host", "robots"), "host", "left")
    return joined.select(*urls.columns, "robots").mapInArrow(run, schema)
