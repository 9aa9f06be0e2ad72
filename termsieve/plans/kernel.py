"""Queries that run the exact check itself over whole tables, and its semantics restated in SQL.

The SQL cuts a segment into e-mail addresses (the exception that occurs in these tables), words and what stands
between them, with their places, and finds phrases, the name in two words and wrong words in this order; what
lies over an earlier find does not count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Market, RuleConfig, RuleVersion
from ..functions import web as W
from ..operators import entities as E
from ..operators import evaluate as V
from ..operators import incremental, rule_index
from ..operators.storage import fresh_path
from ..streaming import state

#: Names that the words of the documents come close to, so that every stage finds something.
WORDS = RuleVersion(21, "WORDS", 1, RuleConfig(canonical="Ention", disallowed=("antion", "and the", "the antion", "in and"), ignore_words=("intion",), severity="high"))
SPLIT = RuleVersion(22, "SPLIT", 1, RuleConfig(canonical="Inthe", disallowed=("in the of",), severity="low"))
FORMS = RuleVersion(
    23,
    "FORMS",
    1,
    RuleConfig(canonical="Velora", fuzzy=False, severity="medium", cross_market="high", locales={"ja": Market(("ベローラ",), ("ベロー",)), "zh-Hans": Market(("维罗",), ("維羅",)), "zh-Hant": Market(("維羅",), ("维罗",))}),
)
SAID = ("ベローラ", "ベロー", "维罗", "維羅")
PAGE = (None, "ja", "zh-CN", "zh-TW", "fr")

_EMAIL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+"
OUT = ["segment_id", "kind", "start", "end", "matched_text", "status", "severity", "confidence"]


def finds_sql(rule: RuleConfig, *tables: str) -> str:
    """WITH clause that ends in finds(segment_id, kind, a, b, note) and out, the columns of a finding."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    name = rule.canonical.lower()
    listed = [d for d in rule.disallowed if " " not in d]
    spelled = [d for d in rule.disallowed if " " in d]
    phrases = [d.lower().split() for d in spelled]
    listed_note = "CASE low " + " ".join(f"WHEN '{d.lower()}' THEN {text(f'listed as a wrong spelling: {d}')}" for d in listed) + " END" if listed else "NULL"
    listed = [d.lower() for d in listed]
    cased = text("letter case; right are " + ", ".join(sorted(rule.allowed_casings)))
    quoted = lambda some: ", ".join(f"'{x}'" for x in some) or "''"
    free = lambda over: " ".join(f"AND NOT EXISTS (SELECT 1 FROM {o} o WHERE o.segment_id = c.segment_id AND o.a < c.b AND c.a < o.b)" for o in over)
    ctes, over = [], []
    for k, said in enumerate(phrases):
        match = " AND ".join([f"low = '{said[0]}'"] + [f"regexp_full_match(p{2 * i - 1}, '\\s+') AND lower(p{2 * i}) = '{x}'" for i, x in enumerate(said) if i])
        last = 2 * len(said) - 1
        ctes.append(
            f"""ph{k} AS (SELECT segment_id, a, b, {text(f"listed as a wrong spelling: {spelled[k]}")} AS note FROM (SELECT segment_id, place AS a, CAST(place + length(p || {" || ".join(f"p{i}" for i in range(1, last))}) AS INTEGER) AS b FROM placed
  WHERE w AND {match} AND NOT regexp_matches(coalesce(before, ''), '[0-9_]$') AND NOT regexp_matches(coalesce(p{last}, ''), '^[0-9_]')) c WHERE TRUE {free(over)})"""
        )
        over.append(f"ph{k}")
    taken = [*over, "sp"]
    words = f"""SELECT * FROM (SELECT segment_id, 'casing' AS kind, CAST(place + k - 1 AS INTEGER) AS a, CAST(place + k - 1 + {len(name)} AS INTEGER) AS b, {cased} AS note FROM (SELECT *, unnest(generate_series(1, length(low) - {len(name) - 1})) AS k FROM placed WHERE w AND contains(low, '{name}'))
    WHERE substring(low, k, {len(name)}) = '{name}' AND substring(p, k, {len(name)}) NOT IN ({quoted(rule.allowed_casings)})
  UNION ALL SELECT segment_id, 'disallowed', place, CAST(place + length(p) AS INTEGER), {listed_note} FROM placed WHERE w AND low IN ({quoted(listed)})
  UNION ALL SELECT segment_id, 'near_miss', place, CAST(place + length(p) AS INTEGER), '1 of ' || greatest(length(p), {len(name)}) || {text(f" letters from {rule.canonical}")} FROM placed WHERE w AND NOT contains(low, '{name}') AND low NOT IN ({quoted([*listed, *rule.ignore_words])}) AND length(low) >= 4
    AND length(low) BETWEEN {len(name) - 1} AND {len(name) + 1} AND damerau_levenshtein(regexp_replace(low, '[^ -~]', '1', 'g'), '{name}') = 1) c WHERE TRUE {free(taken)}"""
    lead = ", ".join(f"lead(p, {i}) OVER s AS p{i}" for i in range(1, 2 * max([2, *map(len, phrases)])))
    joined = ",\n".join(ctes) + ",\n" if ctes else ""
    finds = "".join(f"SELECT segment_id, 'disallowed' AS kind, a, b, note FROM {p} UNION ALL " for p in over)
    return (
        E.with_sql("segments", *tables)
        + f""", cut AS (SELECT segment_id, text, regexp_extract_all(text, '{_EMAIL}|\\p{{L}}+|[^\\p{{L}}]+') AS parts FROM segments),
parts AS (SELECT segment_id, text, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut),
placed AS (SELECT *, CAST(sum(length(p)) OVER s - length(p) AS INTEGER) AS place, lower(p) AS low, regexp_full_match(p, '\\p{{L}}+') AS w, lag(p) OVER s AS before, {lead}
  FROM parts WINDOW s AS (PARTITION BY segment_id ORDER BY i)),
{joined}sp AS (SELECT segment_id, a, b FROM (SELECT segment_id, place AS a, CAST(place + length(p || p1 || p2) AS INTEGER) AS b FROM placed WHERE w AND p1 IN (' ', '-', '.', '·', '‐', '‑') AND regexp_full_match(p2, '\\p{{L}}+') AND lower(p || p2) = '{name}') c WHERE TRUE {free(over)}),
finds AS ({finds}SELECT segment_id, 'split' AS kind, a, b, 'written as two words' AS note FROM sp UNION ALL {words}),
out AS (SELECT f.segment_id, s.run_id, s.asset_id, kind, a AS start, b AS "end", substring(text, a + 1, b - a) AS matched_text, CASE WHEN kind = 'near_miss' THEN 'ambiguous' ELSE 'violation' END AS status,
  CASE WHEN kind = 'near_miss' THEN 'medium' ELSE '{rule.severity}' END AS severity, CASE WHEN kind = 'near_miss' THEN round(1 - 1.0 / greatest(b - a, {len(name)}), 3) ELSE 1.0 END::DOUBLE AS confidence, note
FROM finds f JOIN segments s USING (segment_id))
"""
    )


def _sql(rule: RuleConfig) -> str:
    return finds_sql(rule) + 'SELECT segment_id, kind, start, "end", matched_text, status, severity, confidence FROM out'


def full_sql(rule: RuleVersion) -> str:
    """All columns of the findings of a run: of assets that could be read."""
    c = rule.config
    return finds_sql(c, "assets") + f"""SELECT o.run_id, o.asset_id, segment_id, CAST({rule.rule_id} AS BIGINT) AS rule_id, CAST({rule.version} AS INTEGER) AS rule_version, o.kind, start, "end", matched_text, '{c.canonical}' AS expected, o.status, severity, confidence, note
FROM out o JOIN assets a ON a.asset_id = o.asset_id AND a.run_id = o.run_id AND a.status = 'ok'"""


def summary_sql(rule: RuleVersion) -> str:
    return f"""SELECT run_id, count(*) FILTER (status = 'violation') AS violations, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'dismissed') AS dismissed,
count(DISTINCT asset_id) FILTER (status <> 'dismissed') AS assets_with_findings FROM ({full_sql(rule)}) GROUP BY 1"""


def _checked(rule: RuleVersion) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        rows = E.segments(spark, d).withColumn("language", F.lit(None).cast("string"))
        return V.evaluate(rows, [rule]).select(*OUT)

    return run


def check_words(spark: SparkSession, d: str) -> DataFrame:
    """Wrong case, listed words and phrases, near misses, with claims, by the exact check."""
    return _checked(WORDS)(spark, d)


def check_split_names(spark: SparkSession, d: str) -> DataFrame:
    """A name whose halves are frequent words: found in two words unless a longer listed phrase is there."""
    return _checked(SPLIT)(spark, d)


def check_market_forms(spark: SparkSession, d: str) -> DataFrame:
    """Local forms at the end of lines, on pages of several markets."""
    s, k = E.segments(spark, d), F.col("segment_id")
    said = F.element_at(F.array(*map(F.lit, SAID)), (k % len(SAID) + 1).cast("int"))
    page = F.element_at(F.array(*(F.lit(x).cast("string") for x in PAGE)), (k % len(PAGE) + 1).cast("int"))
    rows = s.select("segment_id", F.concat("text", F.lit(" "), said).alias("text"), page.alias("language"), "visibility")
    return V.evaluate(rows, [FORMS]).select("segment_id", "kind", "start", "matched_text", "expected", "severity")


_FORMS_SQL = E.with_sql("segments") + """, said AS (SELECT segment_id, CAST(length(text) + 1 AS INTEGER) AS start, ['ベローラ', 'ベロー', '维罗', '維羅'][segment_id % 4 + 1] AS form, ['', 'ja', 'zh-Hans', 'zh-Hant', 'fr'][segment_id % 5 + 1] AS market FROM segments),
judged AS (SELECT *, CASE WHEN market = 'ja' AND form = 'ベロー' OR market = 'zh-Hans' AND form = '維羅' OR market = 'zh-Hant' AND form = '维罗' OR market IN ('', 'fr') AND form = 'ベロー' THEN 'disallowed'
  WHEN market = 'ja' AND form = '维罗' OR market IN ('zh-Hans', 'zh-Hant') AND form = 'ベローラ' THEN 'wrong_market_form' END AS kind,
  CASE market WHEN 'ja' THEN 'ベローラ' WHEN 'zh-Hans' THEN '维罗' WHEN 'zh-Hant' THEN '維羅' ELSE 'Velora' END AS expected FROM said)
SELECT segment_id, kind, start, form AS matched_text, expected, CASE kind WHEN 'disallowed' THEN 'medium' ELSE 'high' END AS severity FROM judged WHERE kind IS NOT NULL"""


def masked_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments in which an address is blanked by spaces of its length, by the check's own masker."""
    s = E.segments(spark, d).where(F.contains("text", F.lit("@"))).select("segment_id", "text")
    return V.with_masked(s, ("emails",)).select("segment_id", "masked")


_MASKED_SQL = E.with_sql("segments") + f""", cut AS (SELECT segment_id, regexp_extract_all(text, '{_EMAIL}|[\\s\\S]') AS parts FROM segments WHERE contains(text, '@')),
parts AS (SELECT segment_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut)
SELECT segment_id, string_agg(CASE WHEN length(p) > 1 THEN repeat(' ', length(p)) ELSE p END, '' ORDER BY i) AS masked FROM parts GROUP BY 1"""


def check_summary(spark: SparkSession, d: str) -> DataFrame:
    """Violations and open findings of every asset, from the exact check."""
    found = check_words(spark, d).join(E.segments(spark, d).select("segment_id", "asset_id"), "segment_id")
    return found.groupBy("asset_id").agg(F.count_if(F.col("status") == "violation").alias("violations"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"))


def frequent_names(spark: SparkSession, d: str, most: int) -> list[RuleVersion]:
    """A rule for each of the most frequent words of 5 to 9 letters whose first letter does not come again."""
    low = F.lower("word").alias("low")
    some = E.words(spark, d).select(low).where(r"low RLIKE '^[a-z]{5,9}$' AND instr(substring(low, 2), left(low, 1)) = 0")
    top = some.groupBy("low").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "low").limit(most).collect()  # a report of the top
    return [RuleVersion(k + 1, f"TOP-{k + 1}", 1, RuleConfig(canonical=r.low.capitalize())) for k, r in enumerate(top)]


def findings_of_many_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every segment against the names of the 60 most frequent words, by the rule index."""
    rows = E.segments(spark, d).withColumn("language", F.lit(None).cast("string"))
    return rule_index.evaluate_many(rows, frequent_names(spark, d, 60)).select("segment_id", "rule_id", "kind", "start", "end", "matched_text")


_MANY_SQL = E.with_sql("words") + f""", names AS (SELECT low AS name, upper(low[1]) || low[2:] AS canonical, row_number() OVER (ORDER BY count(*) DESC, low) AS rule_id FROM (SELECT lower(word) AS low FROM words)
  WHERE regexp_full_match(low, '[a-z]{{5,9}}') AND instr(low[2:], low[1]) = 0 GROUP BY low QUALIFY row_number() OVER (ORDER BY count(*) DESC, low) <= 60),
cut AS (SELECT segment_id, regexp_extract_all(text, '{_EMAIL}|\\p{{L}}+|[^\\p{{L}}]+') AS parts FROM segments),
parts AS (SELECT segment_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut),
placed AS (SELECT *, CAST(sum(length(p)) OVER s - length(p) AS INTEGER) AS place, replace(lower(p), 'ß', 'ss') AS low, regexp_full_match(p, '\\p{{L}}+') AS w, lead(p) OVER s AS p1, lead(p, 2) OVER s AS p2 FROM parts WINDOW s AS (PARTITION BY segment_id ORDER BY i)),
met AS (SELECT low, rule_id, name, canonical, contains(low, name) AS has FROM (SELECT DISTINCT low FROM placed WHERE w) JOIN names ON contains(low, name)
  OR (length(low) >= 4 AND length(low) BETWEEN length(name) - 1 AND length(name) + 1 AND damerau_levenshtein(regexp_replace(low, '[^ -~]', '1', 'g'), name) = 1)),
sp AS (SELECT segment_id, rule_id, place AS a, CAST(place + length(p || p1 || p2) AS INTEGER) AS b, p || p1 || p2 AS said FROM placed JOIN names ON replace(lower(p || p2), 'ß', 'ss') = name WHERE w AND p1 IN (' ', '-', '.', '·', '‐', '‑') AND regexp_full_match(p2, '\\p{{L}}+')),
one AS (SELECT segment_id, rule_id, 'casing' AS kind, CAST(place + k - 1 AS INTEGER) AS a, CAST(place + k - 1 + length(substring(p, k, length(name))) AS INTEGER) AS b, substring(p, k, length(name)) AS said
  FROM (SELECT *, unnest(generate_series(1, length(placed.low) - length(name) + 1)) AS k FROM placed JOIN met ON placed.w AND placed.low = met.low AND has) WHERE substring(low, k, length(name)) = name AND substring(p, k, length(name)) <> canonical
  UNION ALL SELECT segment_id, rule_id, 'near_miss', place, CAST(place + length(p) AS INTEGER), p FROM placed JOIN met ON placed.w AND placed.low = met.low AND NOT has)
SELECT segment_id, rule_id, 'split' AS kind, a AS start, b AS "end", said AS matched_text FROM sp
UNION ALL SELECT segment_id, rule_id, kind, a, b, said FROM one WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.segment_id = one.segment_id AND sp.rule_id = one.rule_id AND sp.a < one.b AND one.a < sp.b)"""


CHANGED = 10


def findings_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over all segments with one store of answers. Of the second, every tenth segment has another text than in
    the first; only those texts are checked then. `pass` says whose findings they are."""
    s, assets, path = E.segments(spark, d), E.assets(spark, d), fresh_path(spark, "answers")
    before = s.withColumn("text", F.when(F.col("segment_id") % CHANGED == 0, F.concat("text", F.lit(" antion"))).otherwise(F.col("text")))
    passes = [incremental.evaluate_new(rows, assets, [WORDS], path).findings for rows in (before, s)]
    return reduce(DataFrame.unionByName, (f.select(F.lit(k + 1).alias("pass"), *OUT) for k, f in enumerate(passes)))


def _passes_sql() -> str:
    """The semantics of the check over either pass's texts."""
    after = finds_sql(WORDS.config, "assets")
    before = after.replace("segments AS (", "said AS (", 1)
    head, rest = before.split("cut AS (", 1)
    before = f"{head}segments AS (SELECT * REPLACE (CASE WHEN segment_id % {CHANGED} = 0 THEN text || ' antion' ELSE text END AS text) FROM said), cut AS ({rest}"
    names = 'o.segment_id, o.kind, start, "end", matched_text, o.status, severity, confidence'
    one = lambda k, sql: f"SELECT {k} AS pass, * FROM ({sql} SELECT {names} FROM out o JOIN assets a ON a.asset_id = o.asset_id AND a.run_id = o.run_id AND a.status = 'ok')"
    return one(1, before) + "\nUNION ALL " + one(2, after)


def link_levels(spark: SparkSession, d: str) -> DataFrame:
    """All that can be reached from every fiftieth page, breadth first. A page leads to its links, a link to the pages
    that begin with it."""
    pages = E.pages(spark, d).select("page_id", "url", W.links(F.col("html")).alias("to"))
    links = pages.select(F.col("url").alias("source"), F.explode("to").alias("target"))
    back = pages.where(F.size("to") > 0).select(F.get("to", F.lit(0)).alias("source"), F.col("url").alias("target"))
    return state.crawl_order(links.unionByName(back).distinct(), pages.where("page_id % 50 = 0").select("url"))


_LEVELS_SQL = """WITH RECURSIVE l AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages),
edges AS (SELECT url AS s, unnest(h) AS t FROM l UNION SELECT h[1], url FROM l WHERE len(h) > 0),
r(url, depth) AS (SELECT DISTINCT url, 0 FROM pages WHERE page_id % 50 = 0 UNION SELECT t, depth + 1 FROM r JOIN edges ON s = r.url WHERE depth < 30)
SELECT url, min(depth) AS depth FROM r GROUP BY 1"""


QUERIES = {f.__name__: f for f in (check_words, check_split_names, check_market_forms, masked_segments, check_summary, findings_of_many_rules, findings_incremental, link_levels)}
SQL = {"check_words": _sql(WORDS.config), "check_split_names": _sql(SPLIT.config), "check_market_forms": _FORMS_SQL, "masked_segments": _MASKED_SQL, "findings_of_many_rules": _MANY_SQL, "findings_incremental": _passes_sql(), "link_levels": _LEVELS_SQL}
SQL["check_summary"] = f"""SELECT asset_id, count(*) FILTER (status = 'violation') AS violations, count(*) FILTER (status = 'ambiguous') AS ambiguous
FROM (SELECT segment_id // 100000 AS asset_id, status FROM ({SQL["check_words"]})) GROUP BY 1"""
