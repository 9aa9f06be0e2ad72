"""Order within large groups without bringing a group to one task.

A group of more than LARGE rows is cut into BUCKETS ranges of equal numbers of rows: split points are quantiles of the
group's own numbers (a mergeable summary, combined before it is shuffled), so ids may lie as unevenly as they like. The points
are written once, since two readings of a plan must cut alike. What a window says inside a bucket is completed by one
row a bucket: a group is never more than BUCKETS such rows in one task, and a bucket has its share of the group.
Rows of one number are not told apart by it and share a bucket.

Finding the groups that are large runs a job; a group that is not is one bucket, and without large groups nothing is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import kept

BUCKETS, LARGE = 4096, 1 << 18
#: A quantile is off by one row in so many, at most.
ACCURACY = 20_000


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[f"__{n}"]) for n in names))


def _own(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"__{n}" for n in names})


def _reached(points: Column, at: Column, most: int) -> Column:
    """How many of the ascending points are not above `at`: halving, in place."""
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(points, middle) <= at
        return F.when(s["lo"] >= s["hi"], s).when(below, span(middle + 1, s["hi"])).otherwise(span(s["lo"], middle))

    steps = F.sequence(F.lit(1), F.lit(most.bit_length() + 1))
    return F.aggregate(steps, span(F.lit(0), F.size(points)), halve)["lo"]


def bucketed(rows: DataFrame, by: list[str], at: str, buckets: int = BUCKETS, large: int = LARGE) -> DataFrame:
    """The rows with `__bucket`, their range of `at` (a number, null first) within their group."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > large)
    sizes = kept(_own(sizes.drop("__n"), by), "large-groups")
    if sizes.isEmpty():
        return rows.withColumn("__bucket", F.lit(0))
    shares = [k / buckets for k in range(1, buckets)]
    some = rows.join(sizes, _same(rows, sizes, by), "left_semi").where(F.col(at).isNotNull())
    points = some.groupBy(*by).agg(F.array_distinct(F.percentile_approx(at, shares, ACCURACY)).alias("__points"))
    points = kept(_own(points, by), "split-points")
    joined = rows.join(points, _same(rows, points, by), "left").drop(*(f"__{n}" for n in by))
    place = F.when(F.col(at).isNull(), -1).when(F.col("__points").isNull(), 0).otherwise(_reached(F.col("__points"), F.col(at), buckets))
    return joined.withColumn("__bucket", place).drop("__points")


def _sized(size: DataFrame, by: list[str]) -> DataFrame:
    """The sizes of buckets with the rows of earlier buckets. size: by, __bucket, __n."""
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return size.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def numbered(rows: DataFrame, by: list[str], at: str, name: str = "number", large: int = LARGE) -> DataFrame:
    """The rows with their number (from 1) in the order of `at`, whose values tell a group's rows apart."""
    cut = bucketed(rows, by, at, large=large)
    size = _own(_sized(cut.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n")), by), [*by, "__bucket"])
    inside = cut.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(at)))
    out = inside.join(size, _same(inside, size, [*by, "__bucket"]))
    return out.withColumn(name, F.col("__before") + F.col("__k")).select(*rows.columns, name)


def with_neighbours(rows: DataFrame, by: list[str], at: str, last: str, first: str, large: int = LARGE) -> DataFrame:
    """The rows with `before` (the value of `last` one row earlier) and `after` (of `first` one row later)."""
    cut = bucketed(rows, by, at, large=large)
    inside = Window.partitionBy(*by, "__bucket").orderBy(at)
    cut = cut.withColumns({"before": F.lag(last).over(inside), "after": F.lead(first).over(inside)})
    ends = cut.groupBy(*by, "__bucket").agg(F.min_by(first, at).alias("__first"), F.max_by(last, at).alias("__last"))
    along = Window.partitionBy(*by).orderBy("__bucket")
    ends = _own(ends.select(*by, "__bucket", F.lag("__last").over(along).alias("__b"), F.lead("__first").over(along).alias("__a")), [*by, "__bucket"])
    out = cut.join(ends, _same(cut, ends, [*by, "__bucket"]))
    return out.select(*rows.columns, F.coalesce("before", "__b").alias("before"), F.coalesce("after", "__a").alias("after"))


def streaks(rows: DataFrame, by: list[str], at: str, order: list[str], hit: str, large: int = LARGE) -> DataFrame:
    """(by, first_pos, length) of every run of rows in a row that `hit` is true of.

    at: the leading number of the order. What a bucket says is a summary that can be put together with those beside it: its
    rows, the runs inside it, and the runs that reach its first or last row. Only the latter, two a bucket at
    most, meet across buckets.
    """
    cut = bucketed(rows, by, at, large=large)
    part = [*by, "__bucket"]
    inside = Window.partitionBy(*part).orderBy(*order)
    marked = cut.select(*part, *dict.fromkeys(o for o in order if o not in part), F.col(hit).alias("__hit")).withColumn("__k", F.row_number().over(inside))
    runs = marked.where("__hit").withColumn("__g", F.col("__k") - F.row_number().over(inside))
    runs = runs.groupBy(*part, "__g").agg(F.min("__k").alias("__k"), F.count(F.lit(1)).alias("length"))
    size = marked.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    size = _own(_sized(size, by), part)
    placed = runs.join(size, _same(runs, size, part)).select(
        *by, (F.col("__before") + F.col("__k")).alias("first_pos"), "length", ((F.col("__k") == 1) | (F.col("__k") + F.col("length") - 1 == F.col("__n"))).alias("__edge")
    )
    along = Window.partitionBy(*by).orderBy("first_pos")
    edges = placed.where("__edge")
    opens = F.coalesce(F.lag(F.col("first_pos") + F.col("length")).over(along) != F.col("first_pos"), F.lit(True))
    edges = edges.withColumn("__opens", opens.cast("int")).withColumn("__run", F.sum("__opens").over(along))
    whole = edges.groupBy(*by, "__run").agg(F.min("first_pos").alias("first_pos"), F.sum("length").alias("length"))
    return placed.where("NOT __edge").select(*by, "first_pos", "length").unionByName(whole.select(*by, "first_pos", "length"))
