"""Reports over findings: changes between runs, filters, facets, scores, evidence. All lazy plans.

`rows` are findings joined with their segment and asset: finding_id, run_id, asset_id, segment_id,
start, kind, status, severity, matched_text, text_source, visibility, text, url, asset_kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..config import PRICE_IN, PRICE_OUT, SEVERITY_WEIGHT, VISIBILITY_FACTOR
from ..functions.order import LARGE, streaks, with_neighbours
from ..functions.text import exact_round, exactly_rounded, folded

#: Identity of a finding across runs.
KEY = ["url", "kind", "matched_text", "text_source", "text"]
FACETS = ("status", "kind", "severity", "change", "visibility", "text_source", "asset_kind")
FINISHED = ("completed", "blocked")


def joined(findings: DataFrame, segments: DataFrame, assets: DataFrame) -> DataFrame:
    s = segments.select("segment_id", "text", "text_source", "visibility")
    a = assets.select("asset_id", "url", F.col("kind").alias("asset_kind"))
    return findings.join(s, "segment_id").join(a, "asset_id")


def with_changes(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """`change`: persisting where the earlier run has such a finding, else new; null without an earlier run.

    Keys of the earlier run are aggregated first, so a finding that repeats very often is one row
    of the join.
    """
    if before is None:
        return rows.withColumn("change", F.lit(None).cast("string"))
    known = before.groupBy(*KEY).agg(F.lit("persisting").alias("change"))
    return rows.join(known, KEY, "left").withColumn("change", F.coalesce("change", F.lit("new")))


def fixed(rows: DataFrame, before: DataFrame) -> DataFrame:
    """How many findings of each key are gone: a difference of multisets."""
    b, n = before.groupBy(*KEY).agg(F.count(F.lit(1)).alias("b")), rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return b.join(n, KEY, "left").withColumn("fixed", F.col("b") - F.coalesce("n", F.lit(0))).where("fixed > 0").drop("b", "n")


def change_counts(rows: DataFrame, before: DataFrame) -> DataFrame:
    marked = with_changes(rows, before).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    gone = fixed(rows, before).agg(F.coalesce(F.sum("fixed"), F.lit(0)).alias("n")).select(F.lit("fixed").alias("change"), "n")
    return marked.unionByName(gone)


def filtered(rows: DataFrame, q: str | None = None, **wanted: str | None) -> DataFrame:
    """Comma lists per facet, all of which must hold; q is literal and ignores case."""
    for name, value in wanted.items():
        if name not in FACETS:
            raise ValueError(f"no facet {name}")
        if value:
            rows = rows.where(F.col(name).isin(*value.split(",")))
    if q:
        needle = folded(F.lit(q))
        rows = rows.where(reduce(lambda a, b: a | b, (F.contains(folded(F.col(c)), needle) for c in ("matched_text", "text", "url"))))
    return rows


def facets(rows: DataFrame, names=FACETS) -> DataFrame:
    """(facet, value, n), nulls and empty values left out: one scan, one shuffle of partial counts."""
    names = [n for n in names if n in rows.columns]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))).alias("p")
    return rows.select(pairs).select("p.*").where("coalesce(value, '') <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """A page whose rows carry the number of all rows in `total`."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, offset, limit, *order).crossJoin(F.broadcast(total))  # one row


def _weight(severity: Column, visibility: Column) -> Column:
    w = F.when(F.lit(False), 0)
    for name, value in SEVERITY_WEIGHT.items():
        w = w.when(severity == name, value)
    f = F.when(F.lit(False), 0.0)
    for name, value in VISIBILITY_FACTOR.items():
        f = f.when(visibility == name, value)
    return w.otherwise(1) * f.otherwise(1.0)


def asset_scores(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Per asset that was read: 100 less the weights of its violations, 0 at least."""
    v = rows.where("status = 'violation'").groupBy("asset_id").agg(F.sum(_weight(F.col("severity"), F.col("visibility"))).alias("weight"), F.count(F.lit(1)).alias("violations"), F.count_if(F.col("severity") == "high").alias("high"))
    out = assets.where("status = 'ok'").join(v, "asset_id", "left")
    return out.select(
        "run_id", "asset_id", "url", "kind", F.greatest(F.lit(0.0), 100.0 - F.coalesce("weight", F.lit(0.0))).alias("score"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("high", F.lit(0)).alias("high")
    )


def site_score(scores: DataFrame) -> DataFrame:
    """Per run: mean score, share of assets without a high violation, counts."""
    return scores.groupBy("run_id").agg(
        (F.sum("score") / F.count(F.lit(1))).alias("score"),
        (100 * F.count_if(F.col("high") == 0) / F.count(F.lit(1))).alias("clean_share"),
        F.count(F.lit(1)).alias("assets_checked"),
        F.count_if(F.col("violations") > 0).alias("assets_with_violations"),
        F.sum("violations").alias("violations"),
    )


def worst_assets(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.where("score < 100").orderBy("score", "asset_id").limit(k)


def top_matches(rows: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent wrong texts of violations, ties by the first finding."""
    counted = rows.where("status = 'violation'").groupBy("matched_text").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select("matched_text", "n")


def breakdown(rows: DataFrame, by: str) -> DataFrame:
    return rows.where("status = 'violation'").groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def by_count(counts: DataFrame, name: str) -> DataFrame:
    """Counts as they are shown: most first, then by name."""
    return counts.orderBy(F.desc("n"), name)


def compliance(rows: DataFrame, assets: DataFrame, before: DataFrame | None = None) -> dict:
    """The whole report of one run, with numbers rounded as exact binary values. Results are small by
    their kind: one row, or at most a row per facet value of a closed vocabulary, or a top-k."""
    scores = asset_scores(rows, assets)
    one = site_score(scores).first()
    status = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs = lambda df: {r[0]: r[1] for r in df.collect()}
    return {
        "score": exact_round(one["score"], 1) if one else None,
        "clean_share": exact_round(one["clean_share"], 1) if one else None,
        "assets_checked": one["assets_checked"] if one else 0,
        "assets_with_violations": one["assets_with_violations"] if one else 0,
        "violations": status.get("violation", 0),
        "to_review": status.get("ambiguous", 0),
        "dismissed": status.get("dismissed", 0),
        "by_visibility": pairs(breakdown(rows, "visibility")),
        "by_asset_kind": pairs(breakdown(rows, "asset_kind")),
        "by_kind": pairs(breakdown(rows, "kind")),
        "by_source": pairs(breakdown(rows, "text_source").orderBy(F.desc("n"), "text_source").limit(10)),
        "top_matches": [(r[0], r[1]) for r in top_matches(rows).collect()],
        "worst_assets": [r.asDict() for r in worst_assets(scores).collect()],
        "changes": {"new": 0, "persisting": 0, "fixed": 0} | (pairs(change_counts(rows, before)) if before is not None else {}),
    }


CSV = {
    "finding_id": "finding_id", "status": "status", "type": "kind", "severity": "severity", "found": "matched_text", "expected": "expected", "change": "change", "visibility": "visibility",
    "text_source": "text_source", "asset_kind": "asset_kind", "url": "url", "page_title": "title", "pdf_page": "page", "text": "text", "note": "note", "rule_version": "rule_version",
}


def csv_rows(rows: DataFrame) -> DataFrame:
    """The sixteen columns of an export; what is missing is empty."""
    have = rows.columns
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) if c in have else F.lit("").alias(n) for n, c in CSV.items()))


def write_csv(rows: DataFrame, path: str) -> None:
    """Files that spreadsheets read as UTF-8: the first column's name carries the byte-order mark."""
    first, *rest = csv_rows(rows).columns
    csv_rows(rows).withColumnRenamed(first, "﻿" + first).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def neighbours(findings: DataFrame) -> DataFrame:
    """The findings before and after each one in its run's order (asset, segment, start, id).

    Only the findings of an asset meet in one task; across assets the ends of each are enough, and of these
    only those of a range of ids.
    """
    order = ("segment_id", "start", "finding_id")
    own = Window.partitionBy("run_id", "asset_id").orderBy(*order)
    ends = findings.groupBy("run_id", "asset_id").agg(F.min_by("finding_id", F.struct(*order)).alias("first"), F.max_by("finding_id", F.struct(*order)).alias("last"))
    around = with_neighbours(ends, ["run_id"], "asset_id", "last", "first").select("run_id", "asset_id", "before", "after")
    near = findings.select("run_id", "asset_id", "finding_id", F.lag("finding_id").over(own).alias("p"), F.lead("finding_id").over(own).alias("n"))
    return near.join(around, ["run_id", "asset_id"]).select("finding_id", F.coalesce("p", "before").alias("previous_id"), F.coalesce("n", "after").alias("next_id"))


def latest_runs(runs: DataFrame, *by: str) -> DataFrame:
    """The last finished and evaluated run of each group (runs: run_id, kind, status, findings)."""
    done = runs.where((F.col("kind") == "crawl") & F.col("status").isin(*FINISHED) & F.col("findings").isNotNull())
    return done.groupBy(*by).agg(F.max("run_id").alias("run_id"))


def previous_runs(runs: DataFrame, by: str = "site") -> DataFrame:
    """For each crawl run the one before it of its site that is finished and has been evaluated."""
    crawl = runs.where("kind = 'crawl'")
    good = F.col("status").isin(*FINISHED) & (F.coalesce("findings", F.lit(0)) > 0)
    w = Window.partitionBy(by).orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return crawl.select("run_id", by, F.last(F.when(good, F.col("run_id")), ignorenulls=True).over(w).alias("previous_run_id"))


def only_in(a: DataFrame, b: DataFrame, k: int = 50) -> DataFrame:
    return a.subtract(b).orderBy(*a.columns).limit(k)


def only_in_each(pages: DataFrame, k: int = 50) -> DataFrame:
    """(crawler, url): the first k pages that one crawler alone has. Nothing unless there are two crawlers exactly.

    pages: (crawler, url).
    """
    some = pages.select("crawler", "url").distinct()
    two = some.agg(F.countDistinct("crawler").alias("__n")).where("__n = 2")
    alone = some.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("crawler").alias("crawler")).where("n = 1").select("crawler", "url")
    return capped(alone, "crawler", ["url"], k).where("outcome = 'kept'").select("crawler", "url").crossJoin(F.broadcast(two)).drop("__n")  # one row at most


def asset_list(assets: DataFrame, findings: DataFrame, kind: str | None = None, status: str | None = None, q: str | None = None) -> DataFrame:
    """Assets with how many findings they have; q matches the url or the title as SQL LIKE, its wildcards included."""
    for name, value in (("kind", kind), ("status", status)):
        if value:
            assets = assets.where(F.col(name).isin(*value.split(",")))
    if q:
        like = [F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in ("url", "title") if c in assets.columns]
        assets = assets.where(reduce(lambda a, b: a | b, like))
    n = findings.groupBy("asset_id").agg(F.count(F.lit(1)).alias("findings"))
    return assets.join(n, "asset_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def segments_with_findings(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """Each segment with its findings as an array in order of their start (bounded by the segment's length)."""
    f = findings.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "matched_text"))).alias("found"))
    return segments.join(f, "segment_id", "left").withColumn("n_found", F.coalesce(F.size("found"), F.lit(0)))


def evidence(rows: DataFrame) -> DataFrame:
    """What shows a finding: the image, the document page, the screenshot box, or the markup."""
    box = F.col("screenshot_path").isNotNull() & F.col("bbox").isNotNull()
    shown = F.when(F.col("asset_kind") == "image", "image").when(F.col("asset_kind") == "pdf", "pdf").when(box & (F.col("visibility") == "visible"), "screenshot").when(box, "screenshot+snippet").otherwise("snippet")
    return rows.withColumn("evidence", shown)


def usage(calls: DataFrame, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> DataFrame:
    """Per day: calls, failures, tokens, calls by stage, cost."""
    stage = calls.groupBy(F.to_date("created_at").alias("date"), "stage").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    day = stage.groupBy("date").agg(
        F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "calls")))).alias("stages"),
    )
    return day.withColumn("cost", exactly_rounded(F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out, 4))


def usage_total(days: DataFrame) -> DataFrame:
    """Sums over all days; the cost is the sum of the days' rounded costs."""
    return days.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "failed", "input_tokens", "output_tokens")), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).withColumn("cost", exactly_rounded(F.col("cost"), 4))


def readiness(sites: DataFrame) -> DataFrame:
    """What a site waits for: a check, a new check, a passed one, an acknowledgement, or nothing."""
    state = (
        F.when(F.col("can_crawl").isNull(), "needs_preflight")
        .when(~F.col("checked_fingerprint").eqNullSafe(F.col("fingerprint")), "stale")
        .when(~F.col("can_crawl"), "blocked")
        .when(F.col("acknowledged_at").isNull(), "needs_ack")
        .otherwise("ready")
    )
    return sites.withColumn("readiness", state)


def refusal_streaks(events: DataFrame, key: str, order: list[str], refused: Column, least: int = 3, large: int = LARGE) -> DataFrame:
    """Runs of at least `least` consecutive refusals per key: where they begin and how long they are. order tells a
    key's events apart; a key of any size is dealt out by ranges of its first column."""
    lead, kind = F.col(order[0]), events.schema[order[0]].dataType
    at = F.unix_micros(lead.cast("timestamp")) if isinstance(kind, (TimestampType, TimestampNTZType, DateType)) else lead if isinstance(kind, NumericType) else F.lit(0)
    marked = events.withColumns({"__at": at, "__refused": F.coalesce(refused, F.lit(False))})
    found = streaks(marked, [key], "__at", order, "__refused", large).where(F.col("length") >= least)
    return found.select(key, F.col("first_pos").cast("int").alias("first_pos"), "length")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    names = rows.columns
    first = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return first.select("r.*")


def capped(rows: DataFrame, by: str, order: list, cap: int, salts: int = 1024) -> DataFrame:
    """`kept` for the first `cap` rows of each group, `page_limit` for those after. order: ascending, and
    different for the rows of a group.

    The last order that is kept is found among the first ones of each of `salts` parts of a group, so a
    large group is spread over as many tasks.
    """
    place = F.struct(*(c if isinstance(c, Column) else F.col(c) for c in order))
    marked = rows.withColumn("__at", place)
    part = Window.partitionBy(by, F.pmod(F.xxhash64("__at"), F.lit(salts))).orderBy("__at")
    first = marked.select(by, "__at", F.row_number().over(part).alias("__k")).where(F.col("__k") <= cap).drop("__k")
    last = first.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy("__at"))).where(F.col("__k") == cap)
    last = last.select(F.col(by).alias("__by"), F.col("__at").alias("__last"))
    joined = marked.join(last, marked[by].eqNullSafe(last["__by"]), "left")
    kept = F.col("__last").isNull() | (F.col("__at") <= F.col("__last"))
    return joined.withColumn("outcome", F.when(kept, "kept").otherwise("page_limit")).drop("__at", "__by", "__last")


def stop_reasons(rows: DataFrame, by: str, cap: int) -> DataFrame:
    """Per group: rows that are taken, and `page_limit` where the last of them reached the cap; such a run is complete all the same."""
    done = rows.groupBy(by).agg(F.least(F.count(F.lit(1)), F.lit(cap).cast("long")).alias("done"))
    return done.withColumns({"stop_reason": F.when(F.col("done") >= cap, "page_limit"), "status": F.lit("completed")})


def latest_wins(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Upsert without a table format: of each key the row of the newer table."""
    both = stored.withColumn("__v", F.lit(0)).unionByName(fresh.withColumn("__v", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*stored.columns), "__v").alias("r")).select("r.*")
