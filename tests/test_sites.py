"""Fetching sites: one partition each, paced, every request a row."""

import gzip
import http.server
import json
import threading
import time

import pytest

from termsieve.config import SiteConfig
from termsieve.sources import sites


def urlset(*urls, kind="urlset"):
    return f"<{kind} xmlns='http://s'>{''.join(f'<x><loc>{u}</loc></x>' for u in urls)}</{kind}>".encode()


class Clock:
    def __init__(self):
        self.now = 50.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


HOME = "https://a.test"


def visit(pages, spent=0.25, **more):
    """The requests of a site of made-up answers: (kind, path, seconds waited)."""
    clock, asked = Clock(), []

    def get(url):
        asked.append(clock.now)
        clock.now += spent
        status, body = pages.get(url.removeprefix(HOME), (404, b""))
        return {"status": status, "headers": {}, "final_url": url, "body": body, "truncated": False, "error": None if status else "gone"}

    site = SiteConfig(**{"name": "a", "start_urls": (HOME + "/",), "allowed_domains": ("a.test",), "request_interval_s": 2.0} | more)
    rows = list(sites.Visit(site, get, clock, clock.sleep).rows())
    return [(r["kind"], r["url"].removeprefix(HOME)) for r in rows], rows, asked


def test_pages_come_from_start_pages_and_sitemaps():
    pages = {
        "/robots.txt": (200, f"User-agent: *\nDisallow: /hidden/\nSitemap: {HOME}/top.xml\n".encode()),
        "/top.xml": (200, urlset(f"{HOME}/one.xml", f"{HOME}/two.xml.gz", f"{HOME}/hidden/x.xml", f"{HOME}/none.xml", f"{HOME}/bad.xml", f"{HOME}/top.xml", kind="sitemapindex")),
        "/one.xml": (200, urlset(f"{HOME}/p1", f"{HOME}/p2#part", "https://b.test/p3", f"{HOME}/hidden/p", f"{HOME}:443/p1")),
        "/two.xml.gz": (200, gzip.compress(urlset(f"{HOME}/p4?x=1", f"{HOME}/p2"))),
        "/bad.xml": (200, b"<!DOCTYPE x [<!ENTITY e 'y'>]><urlset/>"),
    }
    got, rows, _ = visit(pages)
    maps = ["/top.xml", "/one.xml", "/two.xml.gz", "/none.xml", "/bad.xml"]
    assert got == [("robots", "/robots.txt"), *(("sitemap", m) for m in maps), *(("page", p) for p in ("/", "/p1", "/p2", "/p4?x=1"))]
    assert "entity" in rows[5]["error"] and rows[4]["status"] == 404
    assert [u for k, u in visit(pages, max_pages=2)[0] if k != "robots"] == ["/top.xml", "/one.xml", "/", "/p1"]
    assert [u for k, u in visit(pages, use_sitemap=False)[0]] == ["/robots.txt", "/"]
    assert [u for k, u in visit(pages, exclude_patterns=(r"p\d$",))[0] if k == "page"] == ["/", "/p4?x=1"]
    assert [u for k, u in visit(pages, include_patterns=(r"p2",), independent=False)[0] if k == "page"] == ["/p2"]


def test_sitemaps_that_never_end_are_capped():
    class Endless(dict):
        def get(self, path, default=None):
            return (404, b"") if path == "/robots.txt" else (200, urlset(f"{HOME}{path}x", kind="sitemapindex"))

    got = visit(Endless())[0]
    assert sum(k == "sitemap" for k, _ in got) == sites.SITEMAPS and got[-1] == ("page", "/")


@pytest.mark.parametrize(("rules", "spent", "apart"), [(b"", 0.5, 2.0), (b"User-agent: *\nCrawl-delay: 5", 0.5, 5.0), (b"User-agent: *\nCrawl-delay: 1", 0.5, 2.0), (b"", 3.5, 3.5)])
def test_requests_are_apart(rules, spent, apart):
    _, rows, asked = visit({"/robots.txt": (200, rules), "/sitemap.xml": (200, urlset(f"{HOME}/a", f"{HOME}/b"))}, spent)
    gaps = [b - a for a, b in zip(asked, asked[1:])]
    assert len(rows) == 5 and all(abs(g - apart) < 1e-9 for g in gaps[1:]) and gaps[0] >= 2.0


def test_a_site_whose_rules_cannot_be_read_is_left_alone():
    assert visit({"/robots.txt": (503, b"")})[0] == [("robots", "/robots.txt")]
    assert len(visit({"/robots.txt": (503, b"")}, respect_robots=False, independent=False)[0]) > 1


def test_source_asks_each_host_in_its_own_partition(spark):
    log: list = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            log.append((time.monotonic(), self.headers["Host"], self.path))
            body = {"/robots.txt": b"User-agent: *\nCrawl-delay: 0.4\n", "/sitemap.xml": urlset(*(f"http://{self.headers['Host']}/p{k}" for k in range(4)))}.get(self.path, b"hello" * 3)
            self.send_response(404 if self.path == "/p3" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(sites.SiteSource)
    some = [SiteConfig("one", (f"http://127.0.0.1:{server.server_port}/",), ("127.0.0.1",), request_interval_s=0.2, independent=False)]
    some.append(SiteConfig("none", ("http://127.0.0.9:1/",), ("127.0.0.9",), request_interval_s=0.1, independent=False))
    df = spark.read.format("site").option("sites", sites.option(some)).load()
    assert df.rdd.getNumPartitions() == 2
    rows = df.collect()
    server.shutdown()
    mine = [r for r in rows if r.site == "one"]
    assert [r.kind for r in mine] == ["robots", "sitemap", *["page"] * 5] and {r.status for r in mine} == {200, 404}
    # When requests were made, and (less exactly, since the server has threads of its own) when they came.
    made = [r.requested_at.timestamp() for r in mine]
    assert made[1] - made[0] > 0.19 and all(b - a > 0.39 for a, b in zip(made[1:], made[2:]))
    assert [p for _, _, p in log[-7:]] == ["/robots.txt", "/sitemap.xml", "/", "/p0", "/p1", "/p2", "/p3"]
    assert log[-1][0] - log[-6][0] > 5 * 0.4 - 0.3
    [gone] = [r for r in rows if r.site == "none"]
    assert gone.error and gone.status is None and gone.kind == "robots"
    with pytest.raises(Exception, match="two sites"):
        spark.read.format("site").option("sites", json.dumps([json.loads(sites.option(some))[0]] * 2)).load().collect()
