"""Sites as a Spark source: one partition a site, which makes its requests one after the other.

    spark.dataSource.register(SiteSource)
    spark.read.format("site").option("sites", json.dumps([{"name": ..., "start_urls": [...], ...}])).load()

All requests of a site (robots.txt, sitemaps, pages) are made by the task of its partition, so they keep the interval of
the site, or the delay its robots.txt asks for, whatever the number of executors. Every request is a row, also
one that failed. A row's `kind` says what was asked for: robots, sitemap or page.

Pages are the start pages and those that sitemaps name, each once, in scope, up to the site's limit; sitemaps are opened while
pages are wanted, those named by robots.txt or the usual one, files named in index files after those that name them. A site
whose robots.txt cannot be read is left alone, unless it is not to be obeyed. Rows stream out as they come; the sites are
a setting, and a partition holds the addresses of one site (bounded by its page limit).
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, fields
from datetime import datetime, timezone
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit
from urllib.request import Request, urlopen
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import SiteConfig
from . import files, robots

SCHEMA = "site string, kind string, url string, status int, headers map<string, string>, final_url string, body binary, truncated boolean, error string, requested_at timestamp, waited double"
#: Sitemap files opened for a site, bytes of a body that are kept, seconds until a request is given up.
SITEMAPS, MOST_BYTES, TIMEOUT, AGENT = 50, 10 * 1024 * 1024, 20.0, "termsieve"


def plain_url(url: str) -> str:
    """Without fragment, user and the port that the scheme has anyway; host in lower case."""
    u = urlsplit(url.strip())
    port = u.port if u.port != {"http": 80, "https": 443}.get(u.scheme) else None
    return f"{u.scheme}://{u.hostname or ''}{f':{port}' if port else ''}{u.path or '/'}{f'?{u.query}' if u.query else ''}"


def reply(url: str) -> dict:
    """What came back; whatever a network does is data here."""
    try:
        try:
            got = urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT)  # noqa: S310
        except HTTPError as e:
            got = e
        with got:
            body = got.read(MOST_BYTES + 1)
            return {"status": got.status, "headers": {k.lower(): v for k, v in got.headers.items()}, "final_url": got.url, "body": body[:MOST_BYTES], "truncated": len(body) > MOST_BYTES, "error": None}
    except Exception as e:
        return {"status": None, "headers": {}, "final_url": None, "body": None, "truncated": False, "error": f"{type(e).__name__}: {e}"}


class Visit:
    """The requests of one site, in order. get, clock and sleep can be given, so tests need no network and no time."""

    def __init__(self, site: SiteConfig, get: Callable[[str], dict] = reply, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.site, self.get, self.clock, self.sleep = site, get, clock, sleep
        self.rules, self.apart, self.free_at = "", site.request_interval_s, None
        self.include, self.exclude = ([re.compile(p) for p in some] for some in (site.include_patterns, site.exclude_patterns))

    def ask(self, kind: str, url: str) -> dict:
        """The row of one request, made when the site may be asked again."""
        waited = 0.0 if self.free_at is None else max(0.0, self.free_at - self.clock())
        if waited:
            self.sleep(waited)
        self.free_at = self.clock() + self.apart
        return {"site": self.site.name, "kind": kind, "url": url, "requested_at": datetime.now(timezone.utc), "waited": waited} | self.get(url)

    def may(self, url: str) -> bool:
        return not self.site.respect_robots or robots.can_fetch(self.rules, url)

    def wanted(self, url: str) -> bool:
        """In scope: the host, robots.txt, then the site's patterns."""
        host = urlsplit(url).hostname or ""
        shown = not self.include or any(p.search(url) for p in self.include)
        return host in self.site.allowed_domains and self.may(url) and shown and not any(p.search(url) for p in self.exclude)

    def robots_txt(self) -> tuple[dict, bool]:
        """The row, and whether the site may be visited."""
        row = self.ask("robots", urljoin(self.site.start_urls[0], "/robots.txt"))
        state = robots.state(row["status"], row["error"])
        if state == "read":
            self.rules = files.decode(row["body"], row["headers"].get("content-type"))
            self.apart = max(self.apart, robots.crawl_delay(self.rules) or 0)
        return row, state != "unavailable" or not self.site.respect_robots

    def sitemaps(self) -> Iterator[tuple[dict, list[str]]]:
        """(row, page addresses) of sitemap files, as they are asked for."""
        waiting = deque(robots.sitemaps(self.rules) or [urljoin(self.site.start_urls[0], "/sitemap.xml")])
        done: set[str] = set()
        while waiting and len(done) < SITEMAPS:
            url = waiting.popleft()
            if url in done or not self.may(url):
                continue
            done.add(url)
            row, names = self.ask("sitemap", url), []
            if row["error"] is None and row["status"] == 200:
                try:
                    kind, names = files.sitemap(row["body"])
                    if kind == "sitemapindex":
                        waiting.extend(names)
                        names = []
                except (ValueError, OSError, EOFError, ElementTree.ParseError, expat.ExpatError) as e:
                    row["error"] = f"could not parse: {e}"
            yield row, names

    def rows(self) -> Iterator[dict]:
        first, welcome = self.robots_txt()
        yield first
        if not welcome:
            return
        pages: dict[str, None] = {}
        room = self.site.max_pages

        def add(urls) -> None:
            for url in map(plain_url, urls):
                if len(pages) < room and self.wanted(url):
                    pages[url] = None

        add(self.site.start_urls)
        named = self.sitemaps() if self.site.use_sitemap else iter(())
        while len(pages) < room and (opened := next(named, None)):
            yield opened[0]
            add(opened[1])
        for url in pages:
            yield self.ask("page", url)


class Site(InputPartition):
    def __init__(self, site: SiteConfig):
        self.site = site


class SiteReader(DataSourceReader):
    def __init__(self, sites: list[SiteConfig]):
        self.sites = sites

    def partitions(self) -> list[Site]:
        return [Site(s) for s in self.sites]

    def read(self, partition: Site) -> Iterator[tuple]:
        names = [f.split()[0] for f in SCHEMA.replace("map<string, string>", "map").split(", ")]
        for row in Visit(partition.site).rows():
            yield tuple(row[n] for n in names)


class SiteSource(DataSource):
    """option `sites`: a JSON list of site settings. Two sites may not share a host, which would be asked twice as often."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SiteReader:
        known = {f.name for f in fields(SiteConfig)}
        sites = [SiteConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k in known}) for s in json.loads(self.options["sites"])]
        hosts = [h for s in sites for h in s.allowed_domains]
        if len(hosts) != len(set(hosts)):
            raise ValueError("a host belongs to two sites")
        return SiteReader(sites)


def option(sites: list[SiteConfig]) -> str:
    """The option's value for these sites."""
    return json.dumps([asdict(s) for s in sites])
