import gzip

import pytest

from termsieve.config import RuleConfig, RuleVersion, SiteConfig
from termsieve.operators import preflight as P
from termsieve.operators import rulebook

S = "https://shop.velora.test"
SITE = SiteConfig("s", (S + "/start",), ("shop.velora.test",))
RULES = f"User-agent: *\nDisallow: /intern\nCrawl-delay: 5\nSitemap: {S}/maps.xml\n"
START = '<html><head><title> Shop  front </title></head><body><a href="/imprint/legal">Who we are</a><a href="/q">Q</a><a href="/agb">Conditions of sale</a></body></html>'


def pages(first, n, *more):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in [*(f"{S}/page{first + i}" for i in range(n)), *more]) + "</urlset>"


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{S}{n}</loc></sitemap>" for n in names) + "</sitemapindex>"


def reply(body=b"", status=200, headers=None, final_url=None, error=None):
    return (status, headers or {}, final_url, bytearray(body.encode() if isinstance(body, str) else body), error)


GOOD = {
    "/robots.txt": reply(RULES),
    "/start": reply(START, headers={"content-type": "text/html"}, final_url=S + "/start"),
    "/maps.xml": reply(index("/m1.xml", "/intern/m.xml", "/m2.xml.gz", "/m3.xml")),
    "/m1.xml": reply(pages(0, 4, "https://else.test/")),
    "/m2.xml.gz": reply(gzip.compress(pages(4, 2, "https://other.test/x").encode())),
    "/m3.xml": reply(pages(10, 5)),
}
WRONG = [
    ({"/robots.txt": reply(status=503)}, "robots", "fail"),
    ({"/robots.txt": reply(status=404)}, "robots", "info"),
    ({"/robots.txt": reply(status=401)}, "robots", "fail"),
    ({"/robots.txt": None}, "robots", "fail"),
    ({"/robots.txt": reply("User-agent: *\nDisallow: /")}, "robots-start", "fail"),
    ({"/start": reply(status=403, headers={"cf-mitigated": "challenge"})}, "start-page", "fail"),
    ({"/start": reply("no", 429, {"server": "Imperva/2"})}, "start-page", "fail"),
    ({"/start": reply(status=None, error="timed out")}, "start-page", "fail"),
    ({"/start": reply("<p>", final_url="https://else.test/")}, "start-page", "fail"),
    ({"/maps.xml": reply('<!DOCTYPE x [<!ENTITY a "b">]><urlset>&a;</urlset>')}, "sitemap", "warn"),
    ({"/maps.xml": reply(status=500)}, "sitemap", "warn"),
    ({"/start": reply("<p>no links")}, "terms", "warn"),
]


def table(spark, by_site):
    rows = [(name, S + path, *r) for name, replies in by_site.items() for path, r in replies.items() if r is not None]
    return spark.createDataFrame(rows, "site string, url string, status int, headers map<string,string>, final_url string, body binary, error string")


def test_good_and_bad_sites(spark):
    """All sites in one table, as a crawl of many sites has them."""
    by_site = {"good": GOOD, "stranger": GOOD} | {f"wrong{k}": GOOD | change for k, (change, _, _) in enumerate(WRONG)}
    sites = {name: SITE for name in by_site if name != "stranger"}
    got = {r.site: r for r in P.preflight(table(spark, by_site), sites).collect()}
    assert set(got) == set(sites)
    status = lambda r: {c.key: c.status for c in r.checks}
    good = got["good"]
    assert good.can_crawl and status(good) == {"robots": "ok", "robots-start": "ok", "start-page": "ok", "sitemap": "ok", "terms": "info"}
    assert {c.key: c.detail for c in good.checks}["start-page"] == "Shop front" and good.crawl_delay == 5
    m = good.sitemap
    assert (m.urls_seen, m.in_scope, m.unchecked, m.sample) == (8, 6, 1, [f"{S}/page{k}" for k in range(6)])
    assert good.terms == [S + "/imprint/legal", S + "/agb"]
    for k, (_, key, want) in enumerate(WRONG):
        r = got[f"wrong{k}"]
        assert status(r)[key] == want and r.can_crawl == (want != "fail"), (k, r)
    said = {k: {c.key: c.detail for c in got[f"wrong{k}"].checks}[key] for k, (_, key, _) in enumerate(WRONG)}
    assert "Cloudflare" in said[5] and "Imperva" in said[6] and said[7] == "timed out" and "else.test" in said[8] and said[3].endswith("not fetched")


def test_sitemaps_are_opened_breadth_first(spark):
    """Index files of index files, one that names itself, and one file named twice: three are opened, level by level."""
    nested = {"/robots.txt": reply("User-agent: *\nDisallow: /no\n"), "/start": reply(START)}
    nested |= {"/sitemap.xml": reply(index("/sitemap.xml", "/no/a.xml", "/deep.xml", "/p.xml", "/deep.xml")), "/deep.xml": reply(index("/last.xml")), "/p.xml": reply(pages(0, 3)), "/last.xml": reply(pages(5, 9))}
    chain = {"/robots.txt": reply(status=404), "/sitemap.xml": reply(index("/a.xml")), "/a.xml": reply(index("/b.xml")), "/b.xml": reply(index("/c.xml", "/d.xml")), "/c.xml": reply(pages(0, 2))}
    got = {r.site: r.sitemap for r in P.preflight(table(spark, {"n": nested, "c": chain, "off": nested}), {"n": SITE, "c": SITE, "off": SiteConfig("s", (S + "/start",), ("shop.velora.test",), use_sitemap=False)}).collect()}
    assert (got["n"].urls_seen, got["n"].unchecked) == (3, 1) and (got["c"].urls_seen, got["c"].unchecked) == (0, 2)
    assert got["off"].urls_seen is None


def test_table_and_fingerprint(spark):
    df = table(spark, {"s": GOOD, "other": GOOD})
    got = P.preflight_table(df, {"s": SITE}).collect()
    assert {(r.site, r.key, r.status) for r in got} == {("s", k, v) for k, v in {"robots": "ok", "robots-start": "ok", "start-page": "ok", "sitemap": "ok", "terms": "info"}.items()} and all(r.can_crawl for r in got)
    assert P.preflight_table(df.limit(0), {"s": SITE}).where("status = 'fail'").count() == 2
    assert P.fingerprint(SITE) != P.fingerprint(SiteConfig("s", (S + "/start",), ("shop.velora.test",), use_sitemap=False))


def test_rulebook(spark):
    one = RuleVersion(1, "B", 1, RuleConfig(canonical="Velora", allowed_casings=("VELORA",)))
    two = one.changed(RuleConfig(canonical="Velora", disallowed=("Vellora",)), enabled=False)
    other = RuleVersion(2, "A", 1, RuleConfig(canonical="Thing"))
    rules = rulebook.load(rulebook.history(spark, [one, two, other]))
    assert [(r.key, r.version, r.enabled) for r in rules] == [("A", 1, True), ("B", 2, False)]
    assert rules[1].config == two.config
    yaml = pytest.importorskip("yaml")
    said = yaml.safe_load(rulebook.to_yaml(rules, "Velora"))
    assert [r["key"] for r in said["rules"]] == ["A", "B"] and said["rules"][1]["config"]["disallowed"] == ["Vellora"]


def test_sql_functions(spark):
    rulebook.register(spark, RuleConfig(canonical="Velora", disallowed=("Vellora",)))
    got = spark.sql("SELECT kind, matched_text, start FROM check_text('see Vellora and velora', 'en')").collect()
    assert [tuple(r) for r in got] == [("disallowed", "Vellora", 4), ("casing", "velora", 16)]
    assert spark.sql("SELECT edit_distance('ca', 'abc') a, market_of('zh_TW') b").first() == (2, "zh-Hant")
