"""Evaluation that checks what is new: findings kept by text, market and rule version.

What the exact check finds depends on the text, the market of its page's language and the version of the rule, on nothing
else. So a folder keeps, for every (digest of the text, market, rule, version) that was ever checked, that it was, and what was found.
An evaluation takes the keys of its segments, leaves out those that are there by an anti-join, checks the texts of the
rest once each, however often they occur, and gives every segment the findings of its text.

A pass is a folder of its own, `pass-<n>`: findings first, then the keys, whose success mark commits it; a pass without
the mark, of a job that was lost, does not count and is written anew. `expired` leaves a pass that has only the keys
still in use and drops those before it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RuleVersion
from ..functions.text import market_of_language
from .evaluate import FOUND, checked_rows, gate, of_interest, with_language
from .storage import children, exists, remove

KEY = ["digest", "market", "rule_id", "rule_version"]
KEYS = "digest binary, market string, rule_id long, rule_version int"
FINDINGS = "digest binary, market string, " + FOUND
_NAME = re.compile(r"pass-(\d{9})(-all)?")


class Evaluated(NamedTuple):
    """checked: how many texts were checked against at least one rule; the others were known."""

    findings: DataFrame
    checked: int


class Answers:
    """The passes in a folder. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def passes(self) -> list[str]:
        """Those that count, in order: from the last that holds all keys on."""
        names = sorted(n for n in children(self.spark, self.path) if _NAME.fullmatch(n) and exists(self.spark, f"{self.path}/{n}/keys/_SUCCESS"))
        whole = [k for k, n in enumerate(names) if n.endswith("-all")]
        return names[whole[-1] :] if whole else names

    def read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{n}/{what}" for n in self.passes()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def keys(self) -> DataFrame:
        return self.read("keys", KEYS)

    def findings(self) -> DataFrame:
        return self.read("findings", FINDINGS)

    def add(self, findings: DataFrame, keys: DataFrame, whole: bool = False) -> None:
        numbers = [int(_NAME.fullmatch(n)[1]) for n in children(self.spark, self.path) if _NAME.fullmatch(n)]
        at = f"{self.path}/pass-{max(numbers, default=0) + 1:09d}{'-all' if whole else ''}"
        findings.write.parquet(f"{at}/findings")
        keys.write.parquet(f"{at}/keys")

    def without(self, names: set[str]) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def keyed(segments: DataFrame, assets: DataFrame) -> DataFrame:
    """Segments that are checked, with the digest of their text and the market of their page ('' if there is none)."""
    languages = with_language(assets).select("run_id", "asset_id", "language")
    rows = of_interest(segments.join(languages, ["run_id", "asset_id"]), "text", "visibility")
    return rows.withColumns({"digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "market": F.coalesce(market_of_language(F.col("language")), F.lit(""))})


def _versions(spark: SparkSession, rules: list[RuleVersion]) -> DataFrame:
    """(rule, rule_id, rule_version): a row for each rule."""
    return spark.createDataFrame([(k, r.rule_id, r.version) for k, r in enumerate(rules)], "rule int, rule_id long, rule_version int")


def evaluate_new(segments: DataFrame, assets: DataFrame, rules: list[RuleVersion], path: str) -> Evaluated:
    """The findings of `evaluate_run`, by checking only texts that were not checked before."""
    spark, active = segments.sparkSession, [r for r in rules if r.enabled]
    answers, rows = Answers(spark, path), keyed(segments, assets)
    versions = F.broadcast(_versions(spark, active))  # a row a rule
    wanted = rows.select("digest", "market").distinct().crossJoin(versions)
    pending = wanted.join(answers.keys(), KEY, "left_anti")
    asked = pending.groupBy("digest", "market").agg(F.collect_list("rule").alias("rules"))  # at most the rules there are

    # Each text once: rows of one digest have the same text.
    texts = rows.select("digest", "market", "text").join(asked.select("digest", "market"), ["digest", "market"], "left_semi").dropDuplicates(["digest", "market"])
    some = texts.join(asked, ["digest", "market"]).where(gate(F.col("text"), active) if active else F.lit(False))
    answers.add(checked_rows(some, active, "text", "market", which="rules").select(*(f.split()[0] for f in FINDINGS.split(", "))), pending.select(*KEY))
    checked = spark.read.parquet(f"{path.rstrip('/')}/{answers.passes()[-1]}/keys").select("digest", "market").distinct().count()

    own = answers.findings().join(versions.drop("rule"), ["rule_id", "rule_version"], "left_semi")
    kept = [c for c in rows.columns if c not in ("text", "digest")]
    found = rows.select(*kept, "digest").join(own, ["digest", "market"])
    return Evaluated(found.select(*(c for c in kept if c != "market"), *(f.split()[0] for f in FOUND.split(", "))), checked)


def expired(segments: DataFrame, assets: DataFrame, rules: list[RuleVersion], path: str) -> None:
    """Only keys that these segments and rules use stay. What was there before goes once the new pass is committed."""
    spark = segments.sparkSession
    answers = Answers(spark, path)
    live = keyed(segments, assets).select("digest", "market").distinct().crossJoin(F.broadcast(_versions(spark, [r for r in rules if r.enabled]).drop("rule")))
    before = {n for n in children(spark, path) if _NAME.fullmatch(n)}
    answers.add(answers.findings().join(live, KEY, "left_semi"), answers.keys().join(live, KEY, "left_semi"), whole=True)
    answers.without(before)
