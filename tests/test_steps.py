"""Model calls, discovery, rule versions and the steps that have no query of their own."""

import os
import random

import pytest

from termsieve.config import RuleConfig, RuleVersion
from termsieve.functions import text as T
from termsieve.operators import evaluate, rulebook
from termsieve.operators import outcomes as O  # noqa: E741
from termsieve.operators import runs as L
from termsieve.plans import report as R
from termsieve.streaming import state

F = R.F
def test_links_are_followed_to_the_end(spark, tmp_path):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)] + [(str(i), "1") for i in range(20)] + [("5", "0"), ("x", "y"), ("3", None), (None, "z")], "source string, target string").cache()
    path = str(tmp_path / "reached")
    out = state.crawl_order(links, spark.createDataFrame([("0",)], "url string"), path, buckets=4)
    assert sorted((r.url, r.depth) for r in out.collect()) == sorted((str(i), i) for i in range(61))
    # A level is appended: each page lies in one file, that of the level it was found in.
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 61 and spark.read.parquet(path).groupBy("url").count().where("count > 1").count() == 0


def test_stops_in_time_do_not_depend_on_arrival(spark, tmp_path):
    """One log dealt over micro-batches in any order, within the lateness: the stops are those of the whole log in order."""
    r = random.Random(12)
    rows = [(k, 60 * n + r.randint(0, 3), n, r.random() < 0.55) for k in "abcdef" for n in range(40)] + [("never", n, n, n % 2 == 0) for n in range(0, 600, 7)]
    log = spark.createDataFrame(rows, "site string, at long, n long, refused boolean").withColumn("ts", F.timestamp_seconds("at"))
    want = R.refusal_streaks(log, "site", ["ts", "n"], F.col("refused"))
    places = {(s, k): at for s in {x[0] for x in rows} for k, (at, *_) in enumerate(sorted((a, n, b) for g, a, n, b in rows if g == s), 1)}
    want = {s: min(places[s, x.first_pos + 2] for x in want.collect() if x.site == s) for s in {x.site for x in want.collect()}}
    assert 4 <= len(want) < 7
    source = str(tmp_path / "in")
    dealt = rows[:]
    r.shuffle(dealt)
    end = [("end", 10**7, 0, False)]
    for k in range(4):
        some = dealt[k::4]
        spark.createDataFrame(some, "site string, at long, n long, refused boolean").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{source}/{k}")
    # What comes after the watermark has passed it does not count: three refusals long ago.
    for k, some in ((4, end), (5, [("late", 5 + n, n, True) for n in range(3)] + [("end", 10**7 + 1, 1, False)])):
        spark.createDataFrame(some, "site string, at long, n long, refused boolean").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{source}/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        stops = state.refusal_stops_in_time(stream, "site", "ts", "refused", "n", late="2 hours")
        q = stops.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(x.site, x.at) for x in spark.table("timed").select("site", F.unix_seconds("stopped_at").alias("at")).collect()]
    assert dict(got) == want and len(got) == len(want)


def test_rules_and_functions_in_sql(spark):
    rule = RuleConfig(canonical="Lumenza")
    h = rulebook.history(spark, [RuleVersion(1, "b", 1, rule), RuleVersion(1, "b", 2, rule), RuleVersion(2, "a", 1, rule)])
    assert [r.version for r in rulebook.versions(h, 1).collect()] == [2, 1] and [r.key for r in rulebook.listed(h).collect()] == ["a", "b"]
    assert rulebook.checker_of("brand_name", {"canonical": "Lumenza"}).check("lumenza")[0].kind == "casing"
    with pytest.raises(ValueError):
        rulebook.checker_of("colour", {})
    rulebook.register(spark, rule)
    assert [r.kind for r in spark.sql("SELECT * FROM check_text('lumenza Lumnza', 'en')").collect()] == ["casing", "near_miss"]
    assert spark.sql("SELECT edit_distance('ca', 'abc'), edit_distance(NULL, 'a'), market_of(' ZH_hk'), market_of(''), market_of('pt-BR'), market_of(NULL)").first()[:] == (2, None, "zh-Hant", None, "pt", None)
    tags = ["zh", "zh-TW", "EN", "", None, " de_AT "]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert df.where("NOT market_of(t) <=> " + "market_of(t)").count() == 0
    assert [r[0] for r in df.select(T.market_of_language(F.col("t"))).collect()] == [r[0] for r in df.selectExpr("market_of(t)").collect()]


def test_occurrences_are_literal(spark):
    df = spark.createDataFrame([("a.b.c", "."), ("x\\Ey\\Ez", "\\E"), ("none", "q"), ("whole", ""), ("aa", "a")], "t string, w string")
    assert [r[0] for r in df.select(T.occurrences(F.col("t"), F.col("w"))).collect()] == [["a", "b", "c"], ["x", "y", "z"], ["none"], ["whole"], ["", "", ""]]


def test_a_stopped_step_leaves_the_rest(spark):
    rows = [(1, i, True, 403 if i in (2, 4, 5) else 200, i == 3) for i in range(12)]
    rows = [(r, i, not robots, s) for r, i, _, s, robots in rows] + [(2, i, True, 200) for i in range(6)]
    df = spark.createDataFrame(rows, "run_id int, asset_id long, allowed boolean, status int").selectExpr("*", "CAST(NULL AS STRING) AS error", "false AS truncated", "true AS is_pdf", "true AS readable")
    got = {(r.run_id, r.asset_id): r.outcome for r in O.file_outcomes(df, limit=4).collect()}
    assert [got[1, i] for i in range(12)] == ["ok", "ok", "blocked", "skipped_robots", *["over_file_limit"] * 8]
    got = {(r.run_id, r.asset_id): r.outcome for r in O.file_outcomes(df, limit=9).collect()}
    # The third blocked reply in a row, robots.txt aside, ends the run's step.
    assert [got[1, i] for i in range(12)] == ["ok", "ok", "blocked", "skipped_robots", "blocked", "blocked", *["not_processed"] * 6]
    assert {got[2, i] for i in range(6)} == {"ok"}
    counts = {r.run_id: r for r in O.outcome_counts(O.file_outcomes(df, limit=5)).collect()}
    assert (counts[2].ok, counts[2].over_file_limit, counts[2].found) == (5, 1, 6)


def test_runs_that_have_ended_stay(spark):
    rows = [(1, "queued"), (2, "running"), (3, "completed"), (4, "cancelled")]
    df = spark.createDataFrame(rows, "run_id int, status string").selectExpr("*", "5L AS total", "3L AS done", "'' AS message", "CAST(NULL AS TIMESTAMP) AS started_at", "CAST(NULL AS TIMESTAMP) AS finished_at", "false AS cancel_requested")
    now, every = F.lit("2026-01-01").cast("timestamp"), F.lit(True)
    status = lambda d: {r.run_id: r.status for r in d.collect()}
    assert status(L.started(df, every, F.lit(9).cast("long"), now)) == {1: "running", 2: "running", 3: "completed", 4: "cancelled"}
    asked = L.cancel_requested(df, every, now)
    assert status(asked) == {1: "cancelled", 2: "running", 3: "completed", 4: "cancelled"}
    assert status(L.progressed(asked, every, F.lit(4).cast("long"), F.lit("x")))[2] == "cancelled"
    assert status(L.finished(df, every, "failed", now)) == {1: "failed", 2: "failed", 3: "completed", 4: "cancelled"}
    with pytest.raises(ValueError):
        L.finished(df, every, "queued", now)


def test_appended_rows_stay(spark, tmp_path):
    path, one = str(tmp_path / "s"), spark.createDataFrame([(1, "a")], "run_id int, text string")
    for _ in range(2):
        evaluate.append(one, path)
    assert spark.read.parquet(path).count() == 2
