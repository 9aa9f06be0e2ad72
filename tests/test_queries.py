import importlib

import pytest

from . import compare
from termsieve.plans import queries as core

NAMES = sorted(core.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connection(sf_dir)


@pytest.mark.parametrize("name", [n for n in NAMES if n in core.oracle_sql()])
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert compare.differences(core.queries()[name](spark, sf_dir), con, core.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n in NAMES if n not in core.oracle_sql()])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_check_equals_the_check_of_each_text(spark, sf_dir):
    from termsieve.functions.spelling import Checker
    from termsieve.operators import entities as E
    from termsieve.operators import evaluate as V

    languages = {r.asset_id: r.language for r in V.with_language(E.assets(spark, sf_dir)).collect()}
    checker = Checker(core.RULE.config)
    want = sorted((s.segment_id, h.kind, h.start, h.end, h.matched, h.status) for s in E.segments(spark, sf_dir).collect() if s.asset_id in languages for h in checker.check(s.text, languages[s.asset_id]))
    got = sorted((r.segment_id, r.kind, r.start, r.end, r.matched_text, r.status) for r in core.findings_full(spark, sf_dir).collect())
    assert got == want and {k for _, k, *_ in want} >= {"casing", "near_miss"}


def written(spark, path, sf_dir, name, rows):
    """A folder of tables in which one has the given rows."""
    spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_phrase_over_an_address_equals_sql(spark, sf_dir, tmp_path):
    d = written(spark, tmp_path, sf_dir, "documents", [(1, "heard and me@mail.example.com the and the antion", "en", "web", 48), (2, "in and a.b@c.example and", "en", "web", 25)])
    for name in ("check_words", "check_summary"):
        assert compare.differences(core.queries()[name](spark, d), compare.connection(d), core.oracle_sql()[name]) == ""


def test_page_with_a_cut_reference_equals_sql(spark, sf_dir, tmp_path):
    html = "<html><head><title>x&amp;&amp</title></head><body><h1>x&amp;&amp</h1><p>a &amp;lt; b &lt c &copy; d & e &am</p></body></html>"
    d = written(spark, tmp_path, sf_dir, "pages", [(1, "http://a.example/1", html)])
    got = core.queries()["page_texts"](spark, d)
    assert compare.differences(got, compare.connection(d), core.oracle_sql()["page_texts"]) == ""
    assert {r.text for r in got.collect()} == {"x&&amp", "a &lt; b &lt c © d & e &am"}


def test_page_of_very_many_blocks_equals_sql(spark, sf_dir, tmp_path):
    html = "<html><head><title>x</title></head><body>" + "".join(f"<p>block {k}</p>" for k in range(20_010)) + "<p>the end</p></body></html>"
    d = written(spark, tmp_path, sf_dir, "pages", [(1, "http://a.example/1", html)])
    got = core.queries()["page_texts"](spark, d)
    assert compare.differences(got, compare.connection(d), core.oracle_sql()["page_texts"]) == ""
    assert got.count() == 20_011
