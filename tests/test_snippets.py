import json

from termsieve.sources.html import extract
from termsieve.sources.snippets import snippet, with_snippets

DATA = {"name": "Lumensa Lamps", "offers": [{"price": 3}]}
PAGE = f"""<!doctype html><html><head><title>Lamps</title><meta name="Keywords" content="lumenza lamps">
<script>var x = "<p>not markup</p>";</script>
<script type="application/ld+json">{json.dumps(DATA)}</script><script type="application/ld+json">{{broken</script></head>
<body><section><h2>One</h2><p>first<p>second <em>part</em></section>
<section id="care" hidden><img alt="a LUMENZA lamp" src="l.png"><table><tr><td>cell<td>other</table></section></body></html>"""
LINKED = 'script[type="application/ld+json"]:nth-of-type(%d)'


def test_elements_as_written():
    assert snippet(PAGE, 'meta[name="keywords"]') == '<meta name="Keywords" content="lumenza lamps">'
    assert snippet(PAGE, "body > section:nth-of-type(1) > p:nth-of-type(2)") == "<p>second <em>part</em>"
    assert snippet(PAGE, "body > section:nth-of-type(1) > h2:nth-of-type(1)") == "<h2>One</h2>"
    assert snippet(PAGE, "#care > table > tr > td:nth-of-type(2)") == "<td>other"
    whole = snippet(PAGE, "#care")
    assert whole.startswith('<section id="care" hidden><img') and whole.endswith("</table></section>")


def test_linked_data_is_counted_by_itself_and_set_in_lines():
    assert snippet(PAGE, LINKED % 1, "json_ld") == json.dumps(DATA, indent=2)
    assert snippet(PAGE, 'script[type="application/ld+json"]', "json_ld") == json.dumps(DATA, indent=2)
    assert snippet(PAGE, LINKED % 2, "json_ld") == "{broken"
    assert snippet(PAGE, LINKED % 3, "json_ld") is None


def test_where_there_is_nothing():
    assert [snippet(PAGE, s) for s in ("#cure", None, "", "p::after", "body > p", "section > em")] == [None] * 6
    assert snippet("", "p") is None
    assert snippet("<h1>" + "y" * 4000, "h1") == "<h1>" + "y" * 1496


def test_every_place_of_extraction_is_found(spark):
    segments = extract(PAGE, "https://x.test/").segments
    rows = spark.createDataFrame([(PAGE, s[3], s[1], s[0]) for s in segments], "html string, selector string, text_source string, text string")
    got = with_snippets(rows).collect()
    assert len(got) == len(segments) > 6 and all(r.snippet for r in got)
