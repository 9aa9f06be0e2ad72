"""Rules as a versioned table, their export, and the check as SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RuleConfig, RuleVersion
from ..functions.spelling import Checker, edit_distance, snippet

HISTORY = T.StructType([T.StructField("rule_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("enabled", T.BooleanType()), T.StructField("config", T.StringType())])


def history(spark: SparkSession, versions: list[RuleVersion]) -> DataFrame:
    import json

    return spark.createDataFrame([(v.rule_id, v.key, v.version, v.enabled, json.dumps(v.config.to_dict() | {"severity": v.config.severity}, ensure_ascii=False)) for v in versions], HISTORY)


def current(history_: DataFrame) -> DataFrame:
    return history_.groupBy("rule_id").agg(F.max_by(F.struct(*history_.columns), "version").alias("r")).select("r.*")


def versions(history_: DataFrame, rule_id: int) -> DataFrame:
    """All versions of a rule, newest first."""
    return history_.where(F.col("rule_id") == rule_id).orderBy(F.desc("version"))


def listed(history_: DataFrame) -> DataFrame:
    """The current version of every rule, by key."""
    return current(history_).orderBy("key")


#: Rule types and what checks them.
TYPES = {"brand_name": (RuleConfig, Checker)}


def checker_of(kind: str, config: dict) -> Checker:
    if kind not in TYPES:
        raise ValueError(f"no rule type {kind}")
    settings, check = TYPES[kind]
    return check(settings.from_dict(config))


def load(history_: DataFrame) -> list[RuleVersion]:
    """The current version of every rule: a table of people's settings, so small by its kind."""
    import json

    rows = current(history_).orderBy("key").collect()
    return [RuleVersion(r.rule_id, r.key, r.version, RuleConfig.from_dict(json.loads(r.config)), r.enabled) for r in rows]


def to_yaml(rules: list[RuleVersion], name: str) -> str:
    import yaml

    said = [{"key": r.key, "version": r.version, "enabled": r.enabled, "severity": r.config.severity, "config": r.config.to_dict()} for r in sorted(rules, key=lambda r: r.key)]
    return yaml.safe_dump({"name": name, "rules": said}, allow_unicode=True, sort_keys=False)


def _edit_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


#: As functions.text.market_of_language, in SQL.
MARKET_OF = """CASE WHEN coalesce(trim(language), '') = '' THEN NULL
  WHEN startswith(lower(trim(language)), 'zh') THEN if(regexp_like(replace(lower(trim(language)), '_', '-'), 'hant|-tw|-hk|-mo'), 'zh-Hant', 'zh-Hans')
  ELSE nullif(substring_index(replace(lower(trim(language)), '_', '-'), '-', 1), '') END"""


def register(spark: SparkSession, rule: RuleConfig) -> None:
    """SQL: SELECT * FROM check_text('text', 'en'); edit_distance(a, b); market_of(language)."""
    from pyspark.sql.functions import udtf

    schema = "kind string, start int, end int, matched_text string, expected string, status string, severity string, confidence double, note string, context string"

    @udtf(returnType=schema)
    class CheckText:
        def __init__(self):
            self.checker = Checker(rule)

        def eval(self, text: str, language: str):
            for h in self.checker.check(text or "", language):
                yield *h, snippet(text, h.start, h.end)

    spark.udtf.register("check_text", CheckText)
    spark.udf.register("edit_distance", F.pandas_udf(_edit_distances, "int"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION market_of(language STRING) RETURNS STRING RETURN {MARKET_OF}")
