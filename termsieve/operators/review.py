"""Reviewing ambiguous findings: candidates, answers kept from before, batches, verdicts, outcomes.

The judge is any function from a batch's prompt and candidates to verdicts; it runs in Arrow batches
on the executors and never sees more than one batch.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REVIEW_BATCH
from ..functions.order import numbered
from ..functions.text import digest_of, snippet

WIDTH = 150
VERDICTS = ("misspelling", "not_brand", "unsure")


def select_candidates(findings: DataFrame, segments: DataFrame, assets: DataFrame, rules: DataFrame) -> DataFrame:
    """Ambiguous findings with their segment's text, their asset's own language and their rule's name,
    allowed casings and severity; a finding that lacks one of the three is left out.

    rules: (rule_id, name, allowed, severity).
    """
    open_ = findings.where("status = 'ambiguous'").select("finding_id", "rule_id", "segment_id", "asset_id", "matched_text", "start")
    said, where = segments.select("segment_id", "text"), assets.select("asset_id", "language")
    return open_.join(said, "segment_id").join(where, "asset_id").join(rules.select("rule_id", "name", "allowed", "severity"), "rule_id")


def candidates(rows: DataFrame, model: str, instructions: str, name: str) -> DataFrame:
    """Ambiguous findings with their surroundings and the key that answers are kept by."""
    out = rows.where("status = 'ambiguous'").withColumn("context", snippet(F.col("text"), F.col("start"), F.col("start") + F.char_length("matched_text"), WIDTH))
    return out.withColumn("key", digest_of(F.lit("judge"), F.lit(model), F.lit(instructions), F.lit(name), F.col("matched_text"), F.col("context"), separator="\x1f"))


def split_known(found: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered before, with the verdict; pending). kept: key, verdict."""
    return found.join(kept.select("key", "verdict"), "key"), found.join(kept, "key", "left_anti")


def batches(pending: DataFrame, size: int = REVIEW_BATCH, by: str = "rule_id") -> DataFrame:
    """Numbers the pending findings of a rule in batches, in order of their id."""
    n = F.col("__number") - 1
    return numbered(pending, [by], "finding_id", "__number").withColumn("batch", F.floor(n / size)).withColumn("number", (n % size + 1).cast("int")).drop("__number")


def prompt(name: str, allowed: list[str], batch: list[dict]) -> str:
    esc = html.escape
    items = [f'<candidate id="{c["number"]}" language="{esc(c["language"] or "unknown")}"><word>{esc(c["matched_text"])}</word><context>{esc(c["context"])}</context></candidate>' for c in batch]
    return "\n".join([f'<brand name="{esc(name)}" allowed="{esc(", ".join(allowed))}"/>', "<candidates>", *items, "</candidates>"])


def judged(numbered: DataFrame, judge: Callable[[str, list[dict]], dict[int, str]], name: str, allowed: list[str], by: str = "rule_id") -> DataFrame:
    """(finding_id, verdict) by asking the judge once a batch; what it leaves out stays null."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        answer = judge(prompt(name, allowed, rows), rows)
        return pa.table({"finding_id": pa.array([r["finding_id"] for r in rows], pa.int64()), "verdict": pa.array([answer.get(r["number"]) for r in rows], pa.string())})

    return numbered.groupBy(by, "batch").applyInArrow(run, "finding_id long, verdict string")


def applied(findings: DataFrame, verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with verdicts taken over: a misspelling is a violation as severe as its rule, another
    word is dismissed, everything else stays as it is. rules: (rule_id, severity)."""
    v = verdicts.where("verdict IS NOT NULL").select("finding_id", F.col("verdict").alias("ai_verdict"))
    own = rules.select("rule_id", F.col("severity").alias("__severity"))
    out = findings.join(v, "finding_id", "left").join(own, "rule_id", "left")
    wrong = F.coalesce(F.col("ai_verdict") == "misspelling", F.lit(False))
    out = out.withColumns(
        {
            "status": F.when(wrong, "violation").when(F.col("ai_verdict") == "not_brand", "dismissed").otherwise(F.col("status")),
            "severity": F.when(wrong, F.coalesce("__severity", "severity")).otherwise(F.col("severity")),
        }
    )
    return out.select(*findings.columns, "ai_verdict")


def outcome(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.coalesce("verdict", F.lit("unanswered")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
