import gzip
import http.server
import struct
import threading

import pytest

from termsieve.sources import files, robots
from termsieve.sources.html import extract, page_segments

ROBOTS = """User-agent: other
Disallow: /

User-agent: a
User-agent: TermSieve # us
Disallow: /private
Allow: /private/ok
Disallow: /*.zip$
Crawl-delay: 5
Sitemap: https://x.example.com/s.xml

User-agent: *
Disallow: /all
"""

PAGE = """<!doctype html><html lang="pt-BR"><head><title>Tea &amp; cups</title><meta name="description" content="Loose leaf since 1911"><meta name="viewport" content="w">
<script type="application/ld+json">{"@type":"Store","name":"Cha Lumenza","url":"https://a.b","offers":[{"n":"green"}]}</script><style>p{}</style></head>
<body><h2>Teas from <em>lumenza</em></h2><p style="display:none">Sold out</p>
<section>First<br>second <p>nested</p> third <a href="/leaf#x">leaf <i>tea</i></a><a href="/leaf#y">same</a> <a href="/menu.pdf">menu</a></section>
<ol><li>x<li>y</ol><img src="cup.png" alt="A cup"><input type=hidden value=token><noscript><p>Without scripts</p></noscript><iframe src="/map">x</iframe></body></html>"""


def test_robots():
    assert robots.can_fetch(ROBOTS, "https://x.example.com/private/a") is False
    assert robots.can_fetch(ROBOTS, "https://x.example.com/private/ok/a") is True
    assert robots.can_fetch(ROBOTS, "https://x.example.com/a.zip") is False
    assert robots.can_fetch(ROBOTS, "https://x.example.com/a.zip?x") is True
    assert robots.can_fetch(ROBOTS, "https://x.example.com/all", "stranger") is False
    assert robots.can_fetch("", "https://x.example.com/") is True
    assert robots.crawl_delay(ROBOTS) == 5 and robots.crawl_delay(ROBOTS, "z") is None
    assert robots.sitemaps(ROBOTS) == ["https://x.example.com/s.xml"]
    assert [g["agents"] for g in robots.applying(ROBOTS)] == [["a", "TermSieve"]]
    assert [robots.state(*x) for x in ((200, None), (404, None), (503, None), (403, None), (None, "timeout"))] == ["read", "none", "unavailable", "unavailable", "unavailable"]


def test_robots_join(spark):
    urls = spark.createDataFrame([("https://x.example.com/private/a",), ("https://y.example.com/private/a",), (None,)], "url string")
    texts = spark.createDataFrame([("x.example.com", ROBOTS)], "host string, robots string")
    assert sorted((r.url or "", r.allowed) for r in robots.with_allowed(urls, texts).collect()) == [("", True), ("https://x.example.com/private/a", False), ("https://y.example.com/private/a", True)]


def test_html(spark):
    p = extract(PAGE, "https://s.example.com/d/")
    got = [(s[0], s[1], s[2]) for s in p.segments]
    assert got[:4] == [("Teas from lumenza", "heading", "visible"), ("Sold out", "text", "hidden"), ("First second third leaf teasame menu", "text", "visible"), ("nested", "text", "visible")]
    assert {("Loose leaf since 1911", "meta:description", "metadata"), ("A cup", "attr:alt", "metadata"), ("token", "hidden_input", "hidden"), ("Without scripts", "noscript", "hidden"), ("Tea & cups", "title", "metadata"), ("Cha Lumenza", "json_ld", "metadata"), ("green", "json_ld", "metadata")} <= set(got)
    assert [s[4] for s in p.segments if s[1] == "json_ld"] == [{"path": "name"}, {"path": "offers[0].n"}]
    assert p.links == {"https://s.example.com/leaf": "leaf tea"} and p.language == "pt-BR"
    assert p.resources == {"https://s.example.com/menu.pdf": ("pdf", "a", True), "https://s.example.com/d/cup.png": ("image", "img", True), "https://s.example.com/map": ("frame", "iframe", True)}
    rows = page_segments(spark.createDataFrame([(1, "https://s.example.com/", PAGE), (2, None, None), (3, "x", "<p>unclosed <b>bold")], "page_id int, url string, html string")).collect()
    assert sorted({r.page_id for r in rows}) == [1, 3]
    assert [r.text for r in rows if r.page_id == 3] == ["unclosed bold"]


def test_xml():
    urlset = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/ </loc></url><url><loc>https://b/</loc></url></urlset>'
    assert files.sitemap(urlset) == ("urlset", ["https://a/", "https://b/"])
    assert files.sitemap(gzip.compress(urlset)) == files.sitemap(urlset)
    with pytest.raises(ValueError):
        files.sitemap(b'<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>&a;</loc></url></urlset>')
    with pytest.raises(ValueError):
        files.gunzip(gzip.compress(b"x" * 100), 10)
    assert files.svg_texts(b'<svg xmlns="http://www.w3.org/2000/svg"><text>One <tspan>two</tspan></text><g><text/></g></svg>') == ["One two"]


def test_xml_frames(spark):
    rows = spark.createDataFrame([(1, bytearray(b"<urlset><url><loc>u</loc></url></urlset>")), (2, bytearray(b"<broken")), (3, None)], "id int, content binary")
    got = {r.id: (r.kind, r.loc, (r.error or "")[:15]) for r in files.sitemap_locations(rows).collect()}
    assert got == {1: ("urlset", "u", ""), 2: (None, None, "could not parse"), 3: (None, None, "could not parse")}


def test_images_and_documents(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 100, 47)
    assert files.image_size(png) == ("png", 100, 47) and files.image_outcome(png) == "too_small"
    assert files.image_outcome(b"GIF89a" + struct.pack("<HH", 60, 60)) == "convert"
    assert [files.image_outcome(x) for x in (None, b"x", b"y" * 100)] == ["failed", "unreadable", "unreadable"]
    assert files.image_outcome(png, 10) == "too_large"
    rows = spark.createDataFrame([(1, bytearray(b"%PDF-1 /Encrypt")), (2, bytearray(b"zz")), (3, bytearray(b"%PDF-1"))], "id int, content binary")
    assert {r.id: r.error for r in files.document_segments(rows).collect()} == {1: "password-protected", 2: "not readable", 3: "no reader installed"}
    got = files.document_segments(rows, lambda body: ([("pdf_text", "line", 1, [0.0, 0.0, 1.0, 1.0])] * 3, None), most=2).groupBy("id").count().collect()
    assert {r["count"] for r in got} == {2}
    assert files.needs_recognition(spark.createDataFrame([("  a ",), ("a long enough text",), (None,)], "text string")).count() == 2


def test_decode_and_storage(spark, tmp_path):
    assert files.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert files.decode(b"\xff", None) == "�" and files.decode(b"a", "text/html; charset=none-such") == "a"
    (tmp_path / "a.html.gz").write_bytes(gzip.compress(b"<p>x"))
    (tmp_path / "b.html").write_bytes(b"<p>y")
    assert sorted(r.html for r in files.snapshots(spark, str(tmp_path)).collect()) == ["<p>x", "<p>y"]
    rows = files.stored(spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")).collect()
    assert len(rows) == 2 and all(r.place == f"files/{r.digest[:2]}/{r.digest}" for r in rows)


def test_fetching(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "missing" in self.path else 200)
            self.end_headers()
            self.wfile.write(b"hello")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = {r.url: r for r in files.fetched(spark.createDataFrame([(base + "/",), (base + "/missing",), ("http://127.0.0.1:1/",)], "url string"), most=3).collect()}
    server.shutdown()
    assert rows[base + "/"].status == 200 and bytes(rows[base + "/"].body) == b"hel" and rows[base + "/"].truncated
    assert rows[base + "/missing"].status == 404 and rows["http://127.0.0.1:1/"].error


def test_transforms_are_kept_with_the_text():
    page = "<div style='text-transform: UPPERCASE'><p>loud</p><p style='text-transform:none'>plain <b>and so on</b></p></div><p>usual</p>"
    got = [(s[0], s[4].get("transform")) for s in extract(page, "https://x.test/").segments]
    assert got == [("loud", "uppercase"), ("plain and so on", None), ("usual", None)]
