"""The engine's tables (runs, assets, segments, findings, calls, verdicts) over general input tables.

Findings made here come from built-in expressions only: words of the text against one name. They are
the relational lane of the naming check, used where every stage of the exact check is not needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W

NAME, CASINGS, LISTED = "thing", ("Thing", "THING"), ("whing", "tiing")
#: Lines of a document and words of a line that ids have room for; with them ids are different for up to
#: 9 * 10**8 documents.
LINES, WORDS = 100_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per document: even ids are one run, odd ids the next; every fifth has no language of its
    own and was found on the asset before it in its run."""
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        key.alias("asset_id"),
        (key % 2 + 1).alias("run_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/p/"), F.floor(key / 2).cast("string"), F.when(key % 10 < 2, ".pdf").otherwise("")).alias("url"),
        F.when(key % 10 < 2, "pdf").otherwise("page").alias("kind"),
        F.when(key % 23 == 0, "failed").when(key % 29 == 0, "skipped").otherwise("ok").alias("status"),
        F.when(key % 5 == 0, "").otherwise(F.col("lang")).alias("language"),
        F.when(key % 5 == 0, key - 2).alias("found_on_id"),
        F.col("source").alias("site"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold more than white space, whole."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", F.col("pos").cast("long").alias("pos"), T.squeezed(F.col("raw")).alias("text"))
    return rows.where("text <> ''").select(
        (F.col("doc_id") * LINES + F.col("pos")).alias("segment_id"),
        F.col("doc_id").alias("asset_id"),
        (F.col("doc_id") % 2 + 1).alias("run_id"),
        "pos",
        F.when(F.col("pos") == 0, "heading").when(F.col("pos") % 7 == 3, "meta:description").otherwise("text").alias("text_source"),
        F.when(F.col("pos") % 7 == 3, "metadata").when(F.col("pos") % 5 == 4, "hidden").otherwise("visible").alias("visibility"),
        "text",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select(*s.columns, F.posexplode(T.words(F.col("text"))).alias("word_at", "word"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per wrong word: another case of the name, a listed spelling, or one plain edit away."""
    w = words(spark, sf_dir).withColumn("low", F.lower("word"))
    joined, listed = F.contains("low", F.lit(NAME)), F.col("low").isin(*LISTED)
    n = F.char_length("low")
    close = (F.octet_length("word") == F.char_length("word")) & n.between(len(NAME) - 1, len(NAME) + 1) & (F.levenshtein("low", F.lit(NAME), 1) == 1)
    kind = F.when((F.col("low") == NAME) & ~F.col("word").isin(*CASINGS), "casing").when((F.col("low") != NAME) & joined, "attached").when(listed, "disallowed").when(close & ~joined, "near_miss")
    f = w.where(joined | listed | n.between(len(NAME) - 1, len(NAME) + 1)).withColumn("kind", kind).where("kind IS NOT NULL")
    return f.select(
        (F.col("segment_id") * WORDS + F.col("word_at")).alias("finding_id"),
        (F.col("asset_id") % 3 + 1).alias("rule_id"),
        "run_id",
        "asset_id",
        "segment_id",
        F.col("word_at").cast("long").alias("start"),
        "kind",
        F.when(F.col("kind") == "near_miss", "ambiguous").when((F.col("kind") == "attached") & (F.col("segment_id") % 11 == 0), "dismissed").otherwise("violation").alias("status"),
        F.when(F.col("kind").isin("casing", "disallowed"), "high").when(F.col("kind") == "near_miss", "medium").otherwise("low").alias("severity"),
        F.col("word").alias("matched_text"),
        "text_source",
        "visibility",
        "text",
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with what their asset says."""
    a = assets(spark, sf_dir).select("asset_id", "url", F.col("kind").alias("asset_kind"), "site")
    return findings(spark, sf_dir).join(a, "asset_id")


def rules(spark: SparkSession) -> DataFrame:
    """(rule_id, name, allowed, severity) of the rules that findings are of."""
    return spark.range(1, 4).select(F.col("id").alias("rule_id"), F.lit("Thing").alias("name"), F.array(*map(F.lit, CASINGS)).alias("allowed"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("id").cast("int")).alias("severity"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one per event, its type as the stage; errors failed."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("stage"),
        F.col("user_id").alias("run_id"),
        (F.col("event_id") % 900 + 100).alias("input_tokens"),
        (F.col("event_id") % 70 + 5).alias("output_tokens"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("ts").alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", W.host(F.col("url")).alias("host"))


#: The same tables for DuckDB.
SQL = {
    "assets": """assets AS (
  SELECT doc_id AS asset_id, doc_id % 2 + 1 AS run_id,
    'https://' || source || '.example.com/p/' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 10 < 2 THEN '.pdf' ELSE '' END AS url,
    CASE WHEN doc_id % 10 < 2 THEN 'pdf' ELSE 'page' END AS kind,
    CASE WHEN doc_id % 23 = 0 THEN 'failed' WHEN doc_id % 29 = 0 THEN 'skipped' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS language,
    CASE WHEN doc_id % 5 = 0 THEN doc_id - 2 END AS found_on_id, source AS site, substring(split_part(text, chr(10), 1), 1, 60) AS title
  FROM documents)""",
    "segments": """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents),
segments AS (
  SELECT doc_id * 100000 + pos AS segment_id, doc_id AS asset_id, doc_id % 2 + 1 AS run_id, pos,
    CASE WHEN pos = 0 THEN 'heading' WHEN pos % 7 = 3 THEN 'meta:description' ELSE 'text' END AS text_source,
    CASE WHEN pos % 7 = 3 THEN 'metadata' WHEN pos % 5 = 4 THEN 'hidden' ELSE 'visible' END AS visibility,
    trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS text
  FROM lines WHERE trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') <> '')""",
    "words": """words AS (
  SELECT *, unnest(regexp_extract_all(text, '\\p{L}+')) AS word, CAST(generate_subscripts(regexp_extract_all(text, '\\p{L}+'), 1) - 1 AS BIGINT) AS word_at FROM segments)""",
    "findings": """kinds AS (
  SELECT *, CASE WHEN lower(word) = 'thing' AND word NOT IN ('Thing', 'THING') THEN 'casing'
    WHEN lower(word) <> 'thing' AND contains(lower(word), 'thing') THEN 'attached'
    WHEN lower(word) IN ('whing', 'tiing') THEN 'disallowed'
    WHEN length(word) BETWEEN 4 AND 6 AND levenshtein(lower(word), 'thing') = 1 AND NOT contains(lower(word), 'thing') AND octet_length(encode(word)) = length(word) THEN 'near_miss' END AS kind
  FROM words),
findings AS (
  SELECT segment_id * 100000 + word_at AS finding_id, asset_id % 3 + 1 AS rule_id, run_id, asset_id, segment_id, word_at AS start, kind,
    CASE WHEN kind = 'near_miss' THEN 'ambiguous' WHEN kind = 'attached' AND segment_id % 11 = 0 THEN 'dismissed' ELSE 'violation' END AS status,
    CASE WHEN kind IN ('casing', 'disallowed') THEN 'high' WHEN kind = 'near_miss' THEN 'medium' ELSE 'low' END AS severity,
    word AS matched_text, text_source, visibility, text
  FROM kinds WHERE kind IS NOT NULL)""",
    "rows": """rows AS (
  SELECT f.*, a.url, a.kind AS asset_kind, a.site FROM findings f JOIN assets a USING (asset_id))""",
    "rules": """rules AS (SELECT * FROM (VALUES (1, 'Thing', 'high'), (2, 'Thing', 'medium'), (3, 'Thing', 'low')) t(rule_id, name, severity))""",
    "calls": """calls AS (
  SELECT event_id AS call_id, event_type AS stage, user_id AS run_id, event_id % 900 + 100 AS input_tokens, event_id % 70 + 5 AS output_tokens,
    event_type <> 'error' AS ok, ts AS created_at FROM events)""",
}


def with_sql(*names: str) -> str:
    """The WITH clause of the named tables and what they need."""
    needs = {"words": ("segments",), "findings": ("words",), "rows": ("findings", "assets")}
    out: list[str] = []

    def add(n):
        for m in needs.get(n, ()):
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in out) + "\n"
