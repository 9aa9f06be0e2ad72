"""What became of files, images and pages: outcomes of a run's fetches, counters, comparison, one segment table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.web import BLOCK_STATUSES

#: Files and images read in a run, at most, and blocked replies in a row that end the step.
FILES, IMAGES, BLOCKS = 200, 100, 3
FILE_OUTCOMES = ("ok", "blocked", "failed", "too_large", "unreadable", "skipped_robots", "over_file_limit", "not_processed")
IMAGE_OUTCOMES = ("ok", "blocked", "failed", "too_small", "skipped_robots", "over_image_limit")


def _blocked() -> Column:
    return F.coalesce(F.col("allowed"), F.lit(True)) & F.coalesce(F.col("status").isin(*BLOCK_STATUSES), F.lit(False))


def _stopped_at(rows: DataFrame, by: str, at: str, in_a_row: int) -> DataFrame:
    """(by, __stop): where a group's blocked replies reach the number in a row that ends its step. What robots.txt
    kept from being fetched neither counts nor interrupts. rows: those within the limit, so a bounded window."""
    fetched = rows.where(F.coalesce("allowed", F.lit(True))).withColumn("__b", _blocked())
    w = Window.partitionBy(by).orderBy(at)
    run = reduce(lambda x, y: x & y, (F.lag("__b", k, False).over(w) for k in range(1, in_a_row)), F.col("__b"))
    return fetched.withColumn("__hit", run).where("__hit").groupBy(by).agg(F.min(at).alias("__stop"))


def _in_order(counted: DataFrame, limit: int, in_a_row: int) -> DataFrame:
    """The numbered rows with the number at which the run's step was stopped (null: never)."""
    stops = _stopped_at(counted.where(F.col("__number") <= limit), "run_id", "__number", in_a_row).withColumnRenamed("run_id", "__run")
    return counted.join(stops, counted["run_id"].eqNullSafe(stops["__run"]), "left").drop("__run")


def file_outcomes(files: DataFrame, limit: int = FILES, in_a_row: int = BLOCKS) -> DataFrame:
    """The files with `outcome`, in the order of their ids within a run.

    files: run_id, asset_id, allowed (by robots.txt), status, error, truncated, is_pdf, readable. A step that is
    stopped leaves the rest of its files, however many, `not_processed`.
    """
    fine = F.col("status").between(200, 299) & F.col("error").isNull()
    n, stop = F.col("__number"), F.col("__stop")
    outcome = (
        F.when(n > stop, "not_processed")
        .when(n > limit, "over_file_limit")
        .when(~F.coalesce("allowed", F.lit(True)), "skipped_robots")
        .when(_blocked(), "blocked")
        .when(~F.coalesce(fine, F.lit(False)), "failed")
        .when(F.col("truncated"), "too_large")
        .when(~F.col("is_pdf"), "failed")
        .when(~F.col("readable"), "unreadable")
        .otherwise("ok")
    )
    return _in_order(numbered(files, ["run_id"], "asset_id", "__number"), limit, in_a_row).withColumn("outcome", outcome).drop("__number", "__stop")


def _seen_first(images: DataFrame) -> DataFrame:
    """The images with their number in the run: visible ones by id, then the others by id."""
    parted = images.withColumn("__seen", F.coalesce("visible", F.lit(False)))
    seen = parted.where("__seen").groupBy(F.col("run_id").alias("__run")).agg(F.count(F.lit(1)).alias("__first"))
    own = numbered(parted, ["run_id", "__seen"], "asset_id", "__number")
    after = F.when(F.col("__seen"), F.lit(0)).otherwise(F.coalesce("__first", F.lit(0)))
    return own.join(seen, own["run_id"].eqNullSafe(seen["__run"]), "left").withColumn("__number", F.col("__number") + after).drop("__seen", "__run", "__first")


def image_outcomes(images: DataFrame, limit: int = IMAGES, in_a_row: int = BLOCKS) -> DataFrame:
    """The images with `outcome`, those that a visitor sees first. A step that is stopped, by blocked replies or by the
    reader (`reader_out`: its limit or the service is gone), leaves the rest without one.

    images: run_id, asset_id, visible, allowed, status, error, truncated, too_small, read_error, reader_out, lines.
    """
    ranked = _in_order(_seen_first(images), limit, in_a_row)
    fine = F.col("status").between(200, 299) & F.col("error").isNull() & ~F.coalesce("truncated", F.lit(False))
    n = F.col("__number")
    outcome = (
        F.when(~F.coalesce("allowed", F.lit(True)), "skipped_robots")
        .when(_blocked(), "blocked")
        .when(~F.coalesce(fine, F.lit(False)), "failed")
        .when(F.col("too_small"), "too_small")
        .when(F.col("read_error"), "failed")
        .otherwise("ok")
    )
    ranked = ranked.withColumn("__outcome", outcome)
    tried = (n <= limit) & (F.col("__stop").isNull() | (n <= F.col("__stop")))
    out = ranked.where(tried & (F.col("__outcome") == "failed") & F.coalesce("reader_out", F.lit(False)) & F.coalesce(fine, F.lit(False)))
    out = out.groupBy(F.col("run_id").alias("__run")).agg(F.min("__number").alias("__out"))
    ranked = ranked.join(out, ranked["run_id"].eqNullSafe(out["__run"]), "left").drop("__run")
    stop = F.least("__stop", "__out")
    said = F.when(n > stop, None).when(n > limit, "over_image_limit").otherwise(F.col("__outcome"))
    return ranked.withColumns({"outcome": said, "stopped_ai": F.col("__out").isNotNull() & (n == F.col("__out")) & (F.col("__stop").isNull() | (F.col("__out") < F.col("__stop")))}).drop("__number", "__stop", "__out", "__outcome")


def outcome_counts(rows: DataFrame, outcomes=FILE_OUTCOMES, **more: Column) -> DataFrame:
    """Per run: how many rows there are of each outcome, how many were found, and further counts."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes]
    return rows.groupBy("run_id").agg(*counts, F.count(F.lit(1)).alias("found"), *(F.count_if(c).alias(n) for n, c in more.items()))


def all_segments(*streams: DataFrame) -> DataFrame:
    """Segments of pages, documents and images in one table; a stream without a column has nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def crawl_counters(assets: DataFrame, segments: DataFrame) -> DataFrame:
    """Per run: maps of pages by status, other files by kind, pages left out by reason, segments by visibility and by source."""

    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        n = rows.where(F.col(key).isNotNull()).groupBy("run_id", F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))

    pages = assets.where("kind = 'page'")
    parts = [
        counted(pages, "status", "pages"),
        counted(assets.where("kind <> 'page'"), "kind", "files"),
        counted(pages.where("status = 'skipped'"), "reason", "skipped"),
        counted(segments, "visibility", "segments"),
        counted(segments, "text_source", "sources"),
    ]
    return reduce(lambda a, b: a.join(b, "run_id", "left"), parts, assets.select("run_id").distinct())


def _of(column: str, key: str) -> Column:
    return F.coalesce(F.element_at(column, F.lit(key)), F.lit(0).cast("long"))


def comparison(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """The latest finished crawls of crawlers side by side: twenty figures each.

    runs: crawler, run_id, status, version, started_at, pages, files, documents, segments (maps of counts), runtime_s,
    pages_runtime_s, peak_rss_mb, cpu_s, errors (an array). scores: run_id, violations, to_review, score.
    """
    said = runs.join(scores.select("run_id", "violations", "to_review", "score"), "run_id", "left")
    return said.select(
        "crawler", "run_id", "status", "version", "started_at",
        *(_of("pages", k).alias(f"pages_{k}") for k in ("ok", "failed", "blocked")),
        F.aggregate(F.coalesce(F.map_values("files"), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x).alias("files_found"),
        _of("documents", "ok").alias("pdfs_read"),
        *(_of("segments", k).alias(f"segments_{k}") for k in ("visible", "hidden", "metadata")),
        "violations", "to_review", "score", F.coalesce("pages_runtime_s", "runtime_s").alias("pages_runtime_s"), "runtime_s", "peak_rss_mb", "cpu_s",
        F.coalesce(F.size("errors"), F.lit(0)).alias("errors"),
    )


def segments_checked(segments: DataFrame) -> DataFrame:
    """Per run: all segments, those that were checked (spoken ones are not), and those with text."""
    spoken = F.coalesce(F.col("visibility"), F.lit("")) == "spoken"
    return segments.groupBy("run_id").agg(F.count(F.lit(1)).alias("segments_checked"), F.count_if(~spoken & F.col("text").isNotNull()).alias("spelling_checked"), F.count_if(spoken).alias("spoken"))
