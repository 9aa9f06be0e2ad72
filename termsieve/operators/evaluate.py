"""Segments against rules: a gate in the JVM, the exact check in Arrow batches, replace-by-run storage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RuleVersion
from ..functions.spelling import SEPARATORS, SHORTEST_NEAR_MISS, Checker, Reading, fold, masked
from ..functions.text import lowered, unusual

FOUND = "rule_id long, rule_version int, kind string, start int, end int, matched_text string, expected string, status string, severity string, confidence double, note string"
_KINDS = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())


#: Where a url begins within a word, which ends there for the check.
INNER_URL = r"(?i)(?<=\p{L})(?:https?://|www\.)"
BLANKS = r"[\s\x1c-\x1f" + "".join("\\" + c if ord(c) < 128 else c for c in SEPARATORS) + "]+"


def gate(text: Column, rules: list[RuleVersion]) -> Column:
    """True for every text that some rule could match; false only for texts that none can and whose characters
    the JVM folds as the check does.

    With white space and separators taken out, a name or a disallowed spelling is a plain substring however it was split;
    a near miss within d edits is within 2 * d plain edits.
    """
    low = lowered(text)
    joined = F.regexp_replace(low, BLANKS, "")
    out = unusual(text)
    strip = lambda s: "".join(c for c in s.casefold() if not c.isspace() and c not in SEPARATORS)
    for rule in rules:
        c = rule.config
        for form in {strip(c.canonical), *(strip(d) for d in c.disallowed)} - {""}:
            out = out | F.contains(joined, F.lit(form))
        if c.fuzzy:
            key, d = c.canonical.casefold(), c.max_edit_distance
            lo, hi = max(SHORTEST_NEAR_MISS, len(key) - d), len(key) + d
            if lo <= hi:
                words = F.regexp_extract_all(low, F.lit(rf"(?<!\p{{L}})\p{{L}}{{{lo},{hi}}}(?!\p{{L}})"), F.lit(0))
                out = out | F.exists(words, lambda w: F.levenshtein(w, F.lit(key), 2 * d) >= 0) | F.rlike(text, F.lit(INNER_URL))
    return out


def of_interest(segments: DataFrame, text: str, visibility: str | None) -> DataFrame:
    """Segments that are checked: with a text, not spoken."""
    rows = segments.where(F.col(text).isNotNull())
    return rows.where(F.coalesce(F.col(visibility), F.lit("")) != "spoken") if visibility else rows


def checked_rows(rows: DataFrame, active: list[RuleVersion], text: str, language: str, which: str | None = None) -> DataFrame:
    """One row per finding of the exact check. which: a column with the numbers of the rules to check, else all are."""
    left_out = {text, which}
    fields = [f for f in rows.schema.fields if f.name not in left_out]

    def run(batches):
        checkers = [(r.rule_id, r.version, Checker(r.config)) if which is None else None for r in active]
        every = range(len(active))
        for batch in batches:
            at, found = [], []
            asked = batch.column(which).to_pylist() if which else [every] * batch.num_rows
            for i, (said, lang, some) in enumerate(zip(batch.column(text).to_pylist(), batch.column(language).to_pylist(), asked)):
                read = {}  # the text, by the exceptions of a rule
                for k in sorted(some):
                    if checkers[k] is None:  # compiled when a text meets it
                        checkers[k] = (active[k].rule_id, active[k].version, Checker(active[k].config))
                    rule_id, version, checker = checkers[k]
                    kinds = tuple(checker.config.exceptions)
                    if kinds not in read:
                        read[kinds] = Reading(said, kinds)
                    for h in checker.check(said, lang, read[kinds]):
                        at.append(i)
                        found.append((rule_id, version, h.kind, h.start, h.end, h.matched, h.expected, h.status, h.severity, h.confidence, h.note))
            if at:
                index = pa.array(at, pa.int32())
                columns = [batch.column(f.name).take(index) for f in fields] + [pa.array(c, k) for c, k in zip(zip(*found), _KINDS)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), *(x.split()[0] for x in FOUND.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{schema}, {FOUND}")


def evaluate(segments: DataFrame, rules: list[RuleVersion], text: str = "text", language: str = "language", visibility: str | None = "visibility") -> DataFrame:
    """One row per finding: the segment's columns but its text, and the finding's.

    Rules that are not enabled and spoken segments are left out. Texts that no rule can match never
    leave the JVM. Every rule is in the plan: for more than a few see `rule_index`.
    """
    active = [r for r in rules if r.enabled]
    rows = of_interest(segments, text, visibility)
    return checked_rows(rows.where(gate(F.col(text), active) if active else F.lit(False)), active, text, language)


def with_masked(rows: DataFrame, kinds: tuple[str, ...], text: str = "text") -> DataFrame:
    """Rows with `masked`: the folded text with its exceptions blanked, as the check reads it."""
    kept = rows.columns

    def run(batches):
        for batch in batches:
            out = [None if t is None else masked(fold(t)[0], kinds) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*kept, "masked"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, masked string")


def with_language(assets: DataFrame) -> DataFrame:
    """Assets that could be read, with the language declared by themselves or by the page that
    linked to them (which must be among them)."""
    ok = assets.where("status = 'ok'")
    page = ok.select(F.col("asset_id").alias("page_id"), F.col("language").alias("page_language"))
    return ok.join(page, ok["found_on_id"] == page["page_id"], "left").withColumn("language", F.coalesce(F.nullif("language", F.lit("")), "page_language")).drop("page_id", "page_language")


def evaluate_run(segments: DataFrame, assets: DataFrame, rules: list[RuleVersion]) -> DataFrame:
    languages = with_language(assets).select("run_id", "asset_id", "language")
    return evaluate(segments.join(languages, ["run_id", "asset_id"]), rules)


def replace_runs(findings: DataFrame, path: str) -> None:
    """Findings of the runs present replace those stored before; other runs stay."""
    findings.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to what is stored by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def summary(findings: DataFrame) -> DataFrame:
    """Counts per run, by status and (dismissed ones left out) by what there is to count."""
    live = F.col("status") != "dismissed"
    return findings.groupBy("run_id").agg(
        F.count_if(F.col("status") == "violation").alias("violations"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("status") == "dismissed").alias("dismissed"),
        F.countDistinct(F.when(live, F.col("asset_id"))).alias("assets_with_findings"),
    )
