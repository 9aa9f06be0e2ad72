"""Order within groups of any size, however their numbers lie."""

import random
from itertools import groupby

import pytest

from termsieve.functions import order
from termsieve.operators import outcomes
from termsieve.plans import report

F = order.F


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(6)


def largest_share(df, by):
    n = df.groupBy(*by, "__bucket").count()
    return max(r["count"] for r in n.collect())


@pytest.mark.parametrize("shape", ["even", "outlier", "powers", "two ends"])
def test_no_bucket_has_more_than_its_share(spark, shape):
    n = 100_000
    at = {
        "even": F.col("id"),
        "outlier": F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")),
        "powers": F.floor(F.pow(F.lit(1.0005), F.col("id") % 50_000) * 1000) * n + F.col("id"),
        "two ends": F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 2**52),
    }[shape]
    rows = spark.range(n).select(F.lit(1).alias("g"), at.cast("long").alias("at"))
    assert largest_share(order.bucketed(rows, ["g"], "at", large=1000), ["g"]) <= 2 * n / order.BUCKETS + 1


@pytest.mark.parametrize("large", [20, 10**6])
def test_numbers_and_neighbours_of_uneven_ids(spark, large):
    r = random.Random(4)
    rows = [(g, int(r.random() ** 6 * 10**12) - 5 * 10**10 * (g or 0)) for g in (1, 2, None) for _ in range(400)] + [(1, None), (7, 3), (2, 9 * 10**17)]
    rows = sorted(set(rows), key=str)
    df = table(spark, rows, "g int, at long")
    want = {g: sorted((a for h, a in rows if h == g), key=lambda a: (a is not None, a or 0)) for g in {g for g, _ in rows}}
    got = order.numbered(df, ["g"], "at", large=large)
    assert got.columns == ["g", "at", "number"]
    assert {(x.g, x["at"], x.number) for x in got.collect()} == {(g, a, k) for g, some in want.items() for k, a in enumerate(some, 1)}
    got = {(x.g, x["at"]): (x.before, x.after) for x in order.with_neighbours(df, ["g"], "at", "at", "at", large=large).collect()}
    assert got == {(g, a): (some[k - 1] if k else None, some[k + 1] if k + 1 < len(some) else None) for g, some in want.items() for k, a in enumerate(some)}


def streaks_by_hand(rows, least):
    out = set()
    for key in {k for k, *_ in rows}:
        own = sorted((ts, n, bad) for k, ts, n, bad in rows if k == key)
        at = 1
        for bad, some in groupby(own, key=lambda x: bool(x[2])):
            some = list(some)
            if bad and len(some) >= least:
                out.add((key, at, len(some)))
            at += len(some)
    return out


@pytest.mark.parametrize(("share", "large"), [(0.5, 30), (0.97, 30), (0.03, 30), (0.9, 10**6), (1.0, 30), (0.0, 30)])
def test_streaks_of_a_key_of_any_size(spark, share, large):
    """One key has most rows; runs of refusals go on over many buckets, or over all of them."""
    r = random.Random(int(share * 100))
    rows = [(k, int(r.random() ** 4 * 10**9), n, r.random() < share if r.random() > 0.01 else None) for k, size in (("hot", 900), ("b", 100), ("c", 3), (None, 50)) for n in range(size)]
    df = table(spark, rows, "site string, ts long, n long, bad boolean")
    got = report.refusal_streaks(df, "site", ["ts", "n"], F.col("bad"), 2, large=large)
    assert {tuple(x) for x in got.collect()} == streaks_by_hand(rows, 2) and dict(got.dtypes)["first_pos"] == "int"


def test_streaks_by_time_and_without_numbers(spark):
    df = spark.createDataFrame([("a", k, f"{k:03d}", k % 4 != 0) for k in range(100)], "site string, k long, word string, bad boolean")
    timed = df.withColumn("ts", F.timestamp_seconds("k"))
    want = {("a", 4 * j + 2, 3) for j in range(25)}
    for first in ("ts", "word", "k"):
        assert {tuple(x) for x in report.refusal_streaks(timed, "site", [first, "word"], F.col("bad"), large=10).collect()} == want


def test_images_that_a_visitor_sees_come_first(spark):
    r = random.Random(6)
    rows = [(1 + (k % 9 == 0), int(r.random() ** 5 * 2**60), r.choice([True, False, None])) for k in range(700)]
    df = table(spark, rows, "run_id int, asset_id long, visible boolean")
    got = {(x.run_id, x.asset_id): x["__number"] for x in outcomes._seen_first(df).collect()}
    for run in (1, 2):
        own = sorted((not v, a) for g, a, v in rows if g == run)
        assert [got[run, a] for _, a in own] == list(range(1, len(own) + 1))
