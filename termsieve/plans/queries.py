"""Every operator as a query over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EXCEPTION_KINDS, REVIEW_BATCH, RuleConfig, RuleVersion
from ..functions import text as T
from ..functions import web as W
from ..operators import entities as E
from ..operators import evaluate as V
from ..operators import review, storage
from ..operators.near import near_misses
from ..sources import files, html, robots
from . import kernel, steps
from . import report as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
with_sql = E.with_sql

RULE = RuleVersion(
    1,
    "NAME-001",
    1,
    RuleConfig(canonical="Thing", allowed_casings=("Thing", "THING"), disallowed=("Whing", "Tiing", "th ing", "the thing"), ignore_words=("tiling",), severity="high"),
)
DOMAINS = ("ththre.example.com", "www.example.org")
INCLUDE, EXCLUDE = (r"/[a-z]{2}/",), (r"[?&]ref=", r"/9\d\d")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def n(alias: str = "n"):
    return F.count(F.lit(1)).alias(alias)


_URL = """u AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
  lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', '')) AS authority,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages),
v AS (SELECT *, regexp_extract(authority, '^([^:]*)', 1) AS host, regexp_extract(authority, ':([0-9]+)$', 1) AS port FROM u),
w AS (SELECT *, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS normalized,
  array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS registrable FROM v)
"""


# --- text and segments


@query(with_sql("segments") + "SELECT segment_id, run_id, pos, text_source, visibility, text FROM segments")
def segments_from_documents(spark, d):
    return E.segments(spark, d).select("segment_id", "run_id", "pos", "text_source", "visibility", "text")


@query("""SELECT doc_id, substring(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), 1, 5000) AS cleaned,
  CAST(length(text) AS BIGINT) AS n_chars_before FROM documents""")
def clean_segments(spark, d):
    return E.table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"), F.char_length("text").cast("long").alias("n_chars_before"))


@query(with_sql("words") + "SELECT lower(word) AS word, count(*) AS n, count(DISTINCT asset_id) AS assets FROM words GROUP BY 1")
def token_counts(spark, d):
    each = E.words(spark, d).groupBy(F.lower("word").alias("word"), "asset_id").agg(n())  # once, so that distinct assets need no expansion
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("assets"))


def _of_kind(kind):
    sql = with_sql("findings") + f"SELECT finding_id, segment_id, start, matched_text, severity FROM findings WHERE kind = '{kind}'"
    return sql, lambda spark, d: E.findings(spark, d).where(F.col("kind") == kind).select("finding_id", "segment_id", "start", "matched_text", "severity")


for _kind in ("casing", "attached", "disallowed", "near_miss"):
    SQL[f"{_kind}_findings"], QUERIES[f"{_kind}_findings"] = _of_kind(_kind)


@query(with_sql("words") + """, tokens AS (
  SELECT lower(word) AS token, count(*) AS n FROM words WHERE length(word) BETWEEN 4 AND 6 AND octet_length(encode(word)) = length(word) GROUP BY 1),
near AS (SELECT *, CAST(damerau_levenshtein(token, 'thing') AS BIGINT) AS distance FROM tokens)
SELECT token, n, distance, round(1 - distance / greatest(length(token), 5), 3) AS confidence FROM near WHERE distance = 1""")
def near_miss_tokens(spark, d):
    w = E.words(spark, d).where(F.char_length("word").between(4, 6) & (F.octet_length("word") == F.char_length("word")))
    return near_misses(w.groupBy(F.lower("word").alias("token")).agg(n()), "token", "thing", 1)


@query(with_sql("words") + """, tokens AS (
  SELECT lower(word) AS token, count(*) AS n FROM words WHERE length(word) BETWEEN 5 AND 9 AND octet_length(encode(word)) = length(word) GROUP BY 1),
near AS (SELECT *, CAST(damerau_levenshtein(token, 'thinger') AS BIGINT) AS distance FROM tokens)
SELECT token, n, distance, round(1 - distance / greatest(length(token), 7), 3) AS confidence FROM near WHERE distance BETWEEN 1 AND 2""")
def near_miss_tokens_two(spark, d):
    """Two edits, transpositions among them."""
    w = E.words(spark, d).where(F.char_length("word").between(5, 9) & (F.octet_length("word") == F.char_length("word")))
    return near_misses(w.groupBy(F.lower("word").alias("token")).agg(n()), "token", "thinger", 2)


_CLAIMS = "'on ' || url || ' by @u' || page_id || ' #p' || page_id || ' in f' || page_id || '.pdf, ' || 'm' || page_id || '@x.test or ' || host || '!'"


@query("WITH " + _URL + """SELECT page_id, 'on ' || repeat(' ', length(url)) || ' by ' || repeat(' ', length(CAST(page_id AS VARCHAR)) + 2) || ' ' || repeat(' ', length(CAST(page_id AS VARCHAR)) + 2) || ' in '
  || repeat(' ', length(CAST(page_id AS VARCHAR)) + 5) || ', ' || repeat(' ', length(CAST(page_id AS VARCHAR)) + 8) || ' or ' || repeat(' ', length(host)) || CASE WHEN starts_with(host, 'www.') THEN ' ' ELSE '!' END AS masked FROM w""")
def masked_claims(spark, d):
    """Every kind of exception in one text: url, handle, hashtag, file, address, domain."""
    p = E.pages(spark, d).select("page_id", "url", "host").withColumn("text", F.expr(_CLAIMS))
    return V.with_masked(p, EXCEPTION_KINDS).select("page_id", "masked")


@query(with_sql("segments") + """, w AS (
  SELECT segment_id, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS parts FROM segments),
i AS (SELECT segment_id, parts, unnest(generate_series(1, len(parts) - 2)) AS k FROM w)
SELECT segment_id, CAST(k - 1 AS BIGINT) AS at, parts[k] || parts[k + 1] || parts[k + 2] AS matched_text FROM i
WHERE parts[k + 1] IN (' ', '-', '.', '·', '‐', '‑') AND lower(parts[k] || parts[k + 2]) = 'than'""")
def split_name_findings(spark, d):
    parts = F.regexp_extract_all("text", F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    s = E.segments(spark, d).select("segment_id", parts.alias("p"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("p") - 3, F.lit(0))), lambda k: (F.size("p") > 2) & F.get("p", k + 1).isin(*" -.·‐‑") & (F.lower(F.concat(F.get("p", k), F.get("p", k + 2))) == "than"))
    return s.select("segment_id", "p", F.explode(at).alias("k")).select("segment_id", F.col("k").cast("long").alias("at"), F.concat(F.get("p", F.col("k")), F.get("p", F.col("k") + 1), F.get("p", F.col("k") + 2)).alias("matched_text"))


@query("""SELECT doc_id, CASE WHEN tag IS NULL OR tag = '' THEN NULL WHEN tag LIKE 'zh%' THEN CASE WHEN regexp_matches(tag, 'hant|-tw|-hk|-mo') THEN 'zh-Hant' ELSE 'zh-Hans' END
  ELSE nullif(split_part(tag, '-', 1), '') END AS market
FROM (SELECT doc_id, replace(lower(trim(CASE doc_id % 6 WHEN 0 THEN lang || '-US' WHEN 1 THEN 'zh_' || lang WHEN 2 THEN 'zh-TW' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE upper(lang) END)), '_', '-') AS tag FROM documents)""")
def market_of_language(spark, d):
    k, lang = F.col("doc_id") % 6, F.col("lang")
    tag = F.when(k == 0, F.concat(lang, F.lit("-US"))).when(k == 1, F.concat(F.lit("zh_"), lang)).when(k == 2, "zh-TW").when(k == 3, "").when(k == 4, None).otherwise(F.upper(lang))
    return E.table(spark, d, "documents").select("doc_id", T.market_of_language(tag).alias("market"))


_MASKS = {"urls": r"(https?://|www\.)[^ \t\n\r\f\x0B]+", "emails": r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+(\.[A-Za-z0-9_\-]+)+", "hashtags": r"(^|[^A-Za-z0-9_#])#[A-Za-z0-9_]+", "handles": r"(^|[^A-Za-z0-9_@])@[A-Za-z0-9_]+"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(lower(text), '{p.replace(chr(92) + 'x0B', chr(92) + 'v')}')) AS BIGINT) AS {k}" for k, p in _MASKS.items()) + " FROM documents")
def mask_counts(spark, d):
    return E.table(spark, d, "documents").select("doc_id", *(F.size(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).cast("long").alias(k) for k, p in _MASKS.items()))


@query(kernel.full_sql(RULE))
def findings_full(spark, d):
    """All stages of the exact check over every segment."""
    return V.evaluate_run(E.segments(spark, d), E.assets(spark, d), [RULE]).select("run_id", "asset_id", "segment_id", "rule_id", "rule_version", "kind", "start", "end", "matched_text", "expected", "status", "severity", "confidence", "note")


@query(kernel.summary_sql(RULE))
def evaluation_summary(spark, d):
    return V.summary(V.evaluate_run(E.segments(spark, d), E.assets(spark, d), [RULE]))


@query(with_sql("findings") + """SELECT finding_id, CASE WHEN l > 0 THEN '…' ELSE '' END || substring(text, l + 1, r - l) || CASE WHEN r < length(text) THEN '…' ELSE '' END AS context
FROM (SELECT finding_id, text, greatest(p - 40, 0) AS l, least(p + length(matched_text) + 40, length(text)) AS r FROM (SELECT *, instr(text, matched_text) - 1 AS p FROM findings))""")
def context_snippets(spark, d):
    p = F.instr("text", F.col("matched_text")) - 1
    return E.findings(spark, d).select("finding_id", T.snippet(F.col("text"), p, p + F.char_length("matched_text")).alias("context"))


@query(with_sql("assets") + """SELECT a.asset_id, coalesce(nullif(a.language, ''), p.language) AS language FROM assets a
LEFT JOIN (SELECT * FROM assets WHERE status = 'ok') p ON a.found_on_id = p.asset_id WHERE a.status = 'ok'""")
def language_fallback(spark, d):
    return V.with_language(E.assets(spark, d)).select("asset_id", "language")


@query("SELECT sha256(text) AS digest, 'files/' || sha256(text)[1:2] || '/' || sha256(text) AS place, CAST(length(text) AS BIGINT) AS n FROM documents GROUP BY text")
def content_dedup(spark, d):
    content = E.table(spark, d, "documents").select(F.col("text").cast("binary").alias("content"))
    return files.stored(content).select("digest", "place", F.char_length(F.col("content").cast("string")).cast("long").alias("n"))


# --- reports over findings


def _counted(by):
    where = "" if by == "status" else " WHERE status <> 'dismissed'"
    sql = with_sql("rows") + f"SELECT run_id, {by}, count(*) AS n FROM rows{where} GROUP BY 1, 2"

    def run(spark, d):
        rows = E.rows(spark, d) if by == "asset_kind" else E.findings(spark, d)
        return (rows if by == "status" else rows.where("status <> 'dismissed'")).groupBy("run_id", by).agg(n())

    return sql, run


for _by in ("status", "kind", "severity", "visibility", "text_source", "asset_kind"):
    SQL[f"findings_by_{_by}"], QUERIES[f"findings_by_{_by}"] = _counted(_by)

_CHANGES = with_sql("rows") + """, now AS (SELECT * FROM rows WHERE run_id = 2), old AS (SELECT * FROM rows WHERE run_id = 1),
before AS (SELECT DISTINCT url, kind, matched_text, text_source, text, 1 AS b FROM old),
marked AS (SELECT now.*, CASE WHEN b IS NULL THEN 'new' ELSE 'persisting' END AS change FROM now LEFT JOIN before USING (url, kind, matched_text, text_source, text))
"""


def _runs(spark, d):
    rows = E.rows(spark, d)
    return rows.where("run_id = 2"), rows.where("run_id = 1")


@query(_CHANGES + "".join(f"{' UNION ALL ' if i else ''}SELECT '{f}' AS facet, {f} AS value, count(*) AS n FROM marked WHERE coalesce({f}, '') <> '' GROUP BY 2" for i, f in enumerate(R.FACETS)))
def facets_all(spark, d):
    return R.facets(R.with_changes(*_runs(spark, d)))


@query(_CHANGES + """SELECT change, count(*) AS n FROM marked GROUP BY 1
UNION ALL SELECT 'fixed', (SELECT count(*) FROM (SELECT url, kind, matched_text, text_source, text FROM old EXCEPT ALL SELECT url, kind, matched_text, text_source, text FROM now))""")
def run_diff(spark, d):
    return R.change_counts(*_runs(spark, d))


@query(_CHANGES + "SELECT url, kind, matched_text, text_source, count(*) AS n FROM (SELECT url, kind, matched_text, text_source, text FROM old EXCEPT ALL SELECT url, kind, matched_text, text_source, text FROM now) GROUP BY ALL")
def run_diff_fixed(spark, d):
    now, old = _runs(spark, d)
    return R.fixed(now, old).groupBy("url", "kind", "matched_text", "text_source").agg(F.sum("fixed").alias("n"))


@query(with_sql("rows") + "SELECT finding_id, kind, severity, url FROM rows WHERE status IN ('violation') AND severity IN ('high', 'low') AND visibility IN ('visible', 'metadata')")
def filtered_findings(spark, d):
    return R.filtered(E.rows(spark, d), status="violation", severity="high,low", visibility="visible,metadata", kind=None).select("finding_id", "kind", "severity", "url")


@query(with_sql("rows") + "SELECT finding_id, matched_text FROM rows WHERE contains(lower(matched_text), 'ngth') OR contains(lower(text), 'ngth') OR contains(lower(url), 'ngth')")
def search_casefold(spark, d):
    return R.filtered(E.rows(spark, d), q="NgTh").select("finding_id", "matched_text")


@query(with_sql("assets", "findings") + """SELECT a.asset_id, a.url, count(f.finding_id) AS findings FROM assets a LEFT JOIN findings f USING (asset_id)
WHERE a.kind IN ('page', 'pdf') AND a.status IN ('ok', 'failed') AND a.url ILIKE '%src1_p/%' OR FALSE GROUP BY 1, 2""".replace("src1_p", "src1_.example.com/p"))
def search_like(spark, d):
    return R.asset_list(E.assets(spark, d), E.findings(spark, d), "page,pdf", "ok,failed", "src1_.example.com/p/").select("asset_id", "url", "findings")


@query(with_sql("assets", "findings") + """SELECT a.asset_id, a.title, count(f.finding_id) AS findings FROM assets a LEFT JOIN findings f USING (asset_id)
WHERE a.url ILIKE '%th_nd%' OR a.title ILIKE '%th_nd%' GROUP BY 1, 2""")
def search_titles(spark, d):
    return R.asset_list(E.assets(spark, d), E.findings(spark, d), q="th_nd").select("asset_id", "title", "findings")


@query(with_sql("assets", "findings") + "SELECT asset_id, count(finding_id) AS findings FROM assets LEFT JOIN findings USING (asset_id) GROUP BY 1")
def asset_findings_count(spark, d):
    return R.asset_list(E.assets(spark, d), E.findings(spark, d)).select("asset_id", "findings")


_SCORES = with_sql("rows") + """, v AS (
  SELECT asset_id, sum(CASE severity WHEN 'high' THEN 10.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END) AS weight, count(*) AS violations, count(*) FILTER (severity = 'high') AS high
  FROM rows WHERE status = 'violation' GROUP BY 1),
scores AS (SELECT a.run_id, a.asset_id, a.url, a.kind, CAST(greatest(0.0, 100.0 - coalesce(weight, 0)) AS DOUBLE) AS score, coalesce(violations, 0) AS violations, coalesce(high, 0) AS high
  FROM assets a LEFT JOIN v USING (asset_id) WHERE a.status = 'ok')
"""


@query(_SCORES + "SELECT * FROM scores")
def asset_scores(spark, d):
    return R.asset_scores(E.findings(spark, d), E.assets(spark, d))


@query(_SCORES + """SELECT run_id, sum(score) / count(*) AS score, 100 * count(*) FILTER (high = 0) / count(*) AS clean_share, count(*) AS assets_checked,
  count(*) FILTER (violations > 0) AS assets_with_violations, CAST(sum(violations) AS BIGINT) AS violations FROM scores GROUP BY 1""")
def site_score(spark, d):
    return R.site_score(R.asset_scores(E.findings(spark, d), E.assets(spark, d)))


@query(_SCORES + "SELECT * FROM scores WHERE score < 100 ORDER BY score, asset_id LIMIT 10")
def worst_assets(spark, d):
    return R.worst_assets(R.asset_scores(E.findings(spark, d), E.assets(spark, d)))


@query(with_sql("findings") + "SELECT matched_text, n FROM (SELECT matched_text, count(*) AS n, min(finding_id) AS first FROM findings WHERE status = 'violation' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 15)")
def top_matches(spark, d):
    return R.top_matches(E.findings(spark, d), 15)


@query(with_sql("findings") + "SELECT finding_id, lag(finding_id) OVER w AS previous_id, lead(finding_id) OVER w AS next_id FROM findings WINDOW w AS (PARTITION BY run_id ORDER BY asset_id, segment_id, start, finding_id)")
def neighbours(spark, d):
    return R.neighbours(E.findings(spark, d))


@query(with_sql("rows") + "SELECT * EXCLUDE (run_id, asset_id) FROM (SELECT finding_id, run_id, asset_id, kind, matched_text FROM rows ORDER BY finding_id LIMIT 50 OFFSET 100)")
def findings_page(spark, d):
    return R.page(E.rows(spark, d), 100, 50, "finding_id").select("finding_id", "kind", "matched_text")


@query(with_sql("rows") + "SELECT finding_id, kind, (SELECT count(*) FROM rows) AS total FROM rows ORDER BY finding_id LIMIT 40 OFFSET 20")
def findings_page_total(spark, d):
    return R.page_with_total(E.rows(spark, d), 20, 40, "finding_id").select("finding_id", "kind", "total")


@query(with_sql("rows") + """SELECT CAST(finding_id AS VARCHAR) AS finding_id, status, kind AS type, severity, matched_text AS found, '' AS expected, '' AS change, visibility, text_source, asset_kind, url,
  '' AS page_title, '' AS pdf_page, text, '' AS note, '' AS rule_version FROM rows""")
def csv_projection(spark, d):
    return R.csv_rows(E.rows(spark, d))


@query(with_sql("findings") + "SELECT s.segment_id, CAST(coalesce(c, 0) AS INT) AS n_found, l AS found FROM segments s LEFT JOIN (SELECT segment_id, count(*) AS c, string_agg(start || ':' || kind || ':' || matched_text, ',' ORDER BY start, kind, matched_text) AS l FROM findings GROUP BY 1) USING (segment_id)")
def asset_detail(spark, d):
    out = R.segments_with_findings(E.segments(spark, d), E.findings(spark, d))
    said = F.transform("found", lambda x: F.concat_ws(":", x["start"].cast("string"), x["kind"], x["matched_text"]))
    return out.select("segment_id", "n_found", F.when(F.col("found").isNotNull(), F.concat_ws(",", said)).alias("found"))


@query(with_sql("assets") + "SELECT p.asset_id, count(c.asset_id) AS files FROM assets p LEFT JOIN assets c ON c.found_on_id = p.asset_id AND c.kind <> 'page' GROUP BY 1")
def files_found_on(spark, d):
    a = E.assets(spark, d)
    c = a.where("kind <> 'page'").groupBy(F.col("found_on_id").alias("asset_id")).agg(n("files"))
    return a.select("asset_id").join(c, "asset_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query(with_sql("rows") + "SELECT finding_id, CASE WHEN asset_kind = 'pdf' THEN 'pdf' WHEN segment_id % 4 = 0 AND visibility = 'visible' THEN 'screenshot' WHEN segment_id % 4 = 0 THEN 'screenshot+snippet' ELSE 'snippet' END AS evidence FROM rows")
def evidence_router(spark, d):
    rows = E.rows(spark, d).withColumns({"screenshot_path": F.lit("s.jpg"), "bbox": F.when(F.col("segment_id") % 4 == 0, F.array(F.lit(0.0)))})
    return R.evidence(rows).select("finding_id", "evidence")


@query(with_sql("segments", "assets") + """SELECT run_id, count(*) AS segments, count(DISTINCT asset_id) AS assets, count(*) FILTER (visibility = 'visible') AS visible, count(*) FILTER (visibility = 'hidden') AS hidden,
  count(*) FILTER (visibility = 'metadata') AS metadata FROM segments GROUP BY 1""")
def run_counters(spark, d):
    one = lambda v: F.count_if(F.col("visibility") == v).alias(v)
    return E.segments(spark, d).groupBy("run_id").agg(n("segments"), F.countDistinct("asset_id").alias("assets"), one("visible"), one("hidden"), one("metadata"))


@query(with_sql("segments") + "SELECT asset_id, visibility, count(*) AS n FROM segments GROUP BY 1, 2")
def segments_by_visibility(spark, d):
    return E.segments(spark, d).groupBy("asset_id", "visibility").agg(n())


@query(with_sql("segments") + """SELECT visibility, n, round(100.0 * n / sum(n) OVER (), 6) AS share, CAST(max(n) OVER () AS BIGINT) AS most FROM (SELECT visibility, count(*) AS n FROM segments GROUP BY 1)""")
def chart_shares(spark, d):
    w = Window.partitionBy(F.lit(0))  # a row per value of a closed vocabulary
    c = E.segments(spark, d).groupBy("visibility").agg(n())
    return c.select("visibility", "n", F.round(100.0 * F.col("n") / F.sum("n").over(w), 6).alias("share"), F.max("n").over(w).alias("most"))


# --- runs and comparison

_RUNS = """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey AS site, CASE WHEN o_orderkey % 9 = 0 THEN 'preflight' ELSE 'crawl' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'blocked' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 4 END AS findings FROM orders)
"""


def _run_log(spark, d):
    k = F.col("o_orderkey")
    return E.table(spark, d, "orders").select(
        k.alias("run_id"), F.col("o_custkey").alias("site"), F.when(k % 9 == 0, "preflight").otherwise("crawl").alias("kind"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "blocked").otherwise("failed").alias("status"), F.when(k % 5 == 0, None).otherwise(k % 4).alias("findings")
    )


@query(_RUNS + "SELECT site, max(run_id) AS run_id FROM runs WHERE kind = 'crawl' AND status IN ('completed', 'blocked') AND findings IS NOT NULL GROUP BY 1")
def latest_run_per_site(spark, d):
    return R.latest_runs(_run_log(spark, d), "site")


@query(_RUNS + """SELECT run_id, site, last_value(CASE WHEN status IN ('completed', 'blocked') AND coalesce(findings, 0) > 0 THEN run_id END IGNORE NULLS)
  OVER (PARTITION BY site ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run_id FROM runs WHERE kind = 'crawl'""")
def previous_run(spark, d):
    return R.previous_runs(_run_log(spark, d))


@query(_RUNS + "SELECT run_id, status FROM runs ORDER BY run_id DESC LIMIT 20")
def recent_runs(spark, d):
    return _run_log(spark, d).orderBy(F.desc("run_id")).limit(20).select("run_id", "status")


def _only(a, b):
    sql = with_sql("assets") + f"SELECT url FROM (SELECT url FROM assets WHERE run_id = {a} AND kind = 'page' AND status = 'ok' EXCEPT SELECT url FROM assets WHERE run_id = {b} AND kind = 'page' AND status = 'ok') ORDER BY url LIMIT 50"

    def run(spark, d):
        ok = E.assets(spark, d).where("kind = 'page' AND status = 'ok'")
        return R.only_in(ok.where(f"run_id = {a}").select("url"), ok.where(f"run_id = {b}").select("url"))

    return sql, run


SQL["only_in_first"], QUERIES["only_in_first"] = _only(1, 2)
SQL["only_in_second"], QUERIES["only_in_second"] = _only(2, 1)


@query(with_sql("assets") + """, p AS (SELECT DISTINCT run_id AS crawler, url FROM assets WHERE kind = 'page' AND status = 'ok'),
a AS (SELECT url, min(crawler) AS crawler FROM p GROUP BY 1 HAVING count(*) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY crawler ORDER BY url) AS n FROM a)
SELECT crawler, url FROM k WHERE n <= 50 AND (SELECT count(DISTINCT crawler) FROM p) = 2""")
def only_in_each(spark, d):
    ok = E.assets(spark, d).where("kind = 'page' AND status = 'ok'")
    return R.only_in_each(ok.select(F.col("run_id").alias("crawler"), "url"))


@query(_SCORES + """SELECT run_id, avg(score) AS score, count(*) FILTER (kind = 'page') AS pages_ok, count(*) FILTER (kind = 'pdf') AS pdfs_read,
  CASE WHEN avg(score) > (SELECT avg(score) FROM scores s WHERE s.run_id <> scores.run_id) THEN 'better' ELSE NULL END AS marker FROM scores GROUP BY run_id""")
def comparison(spark, d):
    s = R.asset_scores(E.findings(spark, d), E.assets(spark, d))
    c = s.groupBy("run_id").agg(F.avg("score").alias("score"), F.count_if(F.col("kind") == "page").alias("pages_ok"), F.count_if(F.col("kind") == "pdf").alias("pdfs_read"))
    w = Window.partitionBy(F.lit(0))  # two rows
    other = F.min("score").over(w)
    tie = F.max("score").over(w) == other
    return c.select("*", F.when(~tie & (F.col("score") > other), "better").alias("marker"))


# --- URLs and pages



@query("WITH " + _URL + "SELECT page_id, scheme, host, path, query, normalized, registrable FROM w")
def url_parts(spark, d):
    u = F.col("url")
    return E.pages(spark, d).select("page_id", W.scheme(u).alias("scheme"), "host", W.path(u).alias("path"), W.query(u).alias("query"), W.normalized(u).alias("normalized"), W.registrable(F.col("host")).alias("registrable"))


_FORMS = ("""SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000, upper(split_part(url, ':', 1)) || '://U:p@' || upper(split_part(split_part(url, '://', 2), '/', 1)) || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END
  || substring(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 1) || CASE WHEN contains(url, '#') THEN '' ELSE '#end' END, html FROM pages WHERE page_id % 3 = 0""")


@query("WITH " + _URL.replace("FROM pages)", f"FROM ({_FORMS}))", 1) + "SELECT normalized, count(*) AS n, min(page_id) AS first FROM w GROUP BY 1 HAVING count(*) > 1")
def normalized_url_duplicates(spark, d):
    """A third of the pages has a second address: scheme and host in capitals, a user, the usual port, a fragment."""
    p = E.pages(spark, d).select("page_id", "url")
    scheme, rest = F.substring_index("url", ":", 1), F.substring_index("url", "://", -1)
    host = F.substring_index(rest, "/", 1)
    port, end = F.when(scheme == "https", ":443").otherwise(":80"), F.when(F.contains("url", F.lit("#")), "").otherwise("#end")
    other = F.concat(F.upper(scheme), F.lit("://U:p@"), F.upper(host), port, F.substr(rest, F.char_length(host) + 1), end)
    more = p.where("page_id % 3 = 0").select((F.col("page_id") + 1000000).alias("page_id"), other.alias("url"))
    return p.unionByName(more).groupBy(W.normalized(F.col("url")).alias("normalized")).agg(n(), F.min("page_id").alias("first")).where("n > 1")


@query("WITH " + _URL + f"""SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'not_http'
  WHEN host NOT IN {DOMAINS} THEN CASE WHEN registrable IN ('example.com', 'example.org') THEN 'subdomain' ELSE 'third_party' END
  WHEN NOT regexp_matches(url, '{INCLUDE[0]}') THEN 'not_included' WHEN regexp_matches(url, '{EXCLUDE[0]}') OR regexp_matches(url, '{EXCLUDE[1]}') THEN 'excluded' END AS reason FROM w""")
def skip_reason(spark, d):
    return E.pages(spark, d).select("page_id", W.page_reason(F.col("url"), DOMAINS, INCLUDE, EXCLUDE).alias("reason"))


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '\\.pdf$') THEN 'pdf' WHEN regexp_matches(p, '\\.(docx?|pptx?|xlsx?|odt|odp|ods|rtf)$') THEN 'office' WHEN regexp_matches(p, '\\.(jpe?g|png|gif|webp|avif|svg|bmp|tiff?)$') THEN 'image'
  WHEN regexp_matches(p, '\\.(mp4|webm|mov|m4v|m3u8|ogv)$') THEN 'video' WHEN regexp_matches(p, '\\.(mp3|wav|m4a|aac|oga|ogg|flac)$') THEN 'audio' WHEN regexp_matches(p, '\\.(vtt|srt)$') THEN 'subtitle' END AS kind
FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)) || list_value('', '.pdf', '.DOCX', '.jpeg', '.webm', '.flac', '.vtt')[page_id % 7 + 1] AS q, lower(q) AS p FROM pages)""")
def file_kind(spark, d):
    more = F.element_at(F.array(*(F.lit(x) for x in ("", ".pdf", ".DOCX", ".jpeg", ".webm", ".flac", ".vtt"))), (F.col("page_id") % 7 + 1).cast("int"))
    bare = F.regexp_extract("url", r"^([^?#]*)", 1)
    return E.pages(spark, d).select("page_id", W.file_kind(F.concat(bare, more)).alias("kind"))


@query("SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), '') AS title, nullif(regexp_extract(html, '<html[^>]*\\slang=\"([^\"]*)\"', 1), '') AS language FROM pages")
def page_title_language(spark, d):
    return E.pages(spark, d).select("page_id", W.title(F.col("html")).alias("title"), W.language(F.col("html")).alias("language"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, href, CAST(min(pos) AS INT) AS pos FROM l GROUP BY 1, 2""")
def page_links(spark, d):
    l = E.pages(spark, d).select("page_id", F.posexplode(W.links(F.col("html"))).alias("pos", "href"))
    return R.first_seen(l.withColumn("k", F.struct("page_id", "href")), "k", ["pos"]).drop("k").select("page_id", "href", "pos")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'),
  '(?s)<template.*?</template>', ' ', 'g'), '(?s)<noscript.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS text FROM pages""")
def page_text(spark, d):
    return E.pages(spark, d).select("page_id", W.visible_text(F.col("html")).alias("text"))


def _captures(spark, d):
    k = F.col("page_id")
    return E.pages(spark, d).withColumns({"status": F.when(k % 11 == 0, 403).when(k % 13 == 0, 404).otherwise(200), "final_url": F.when(k % 7 == 0, "https://elsewhere.test/").otherwise(F.lit("https://www.example.org/a")), "html": F.when(k % 17 == 0, None).when(k % 19 == 0, F.concat("html", F.lit("CF-CHL"))).otherwise(F.col("html"))})


_CAPTURES = """WITH c AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 403 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status, page_id % 7 = 0 AS away,
  CASE WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 19 = 0 THEN html || 'CF-CHL' ELSE html END AS html FROM pages),
b AS (SELECT *, status = 403 OR contains(lower(coalesce(html, '')[1:200000]), 'cf-chl') OR contains(lower(coalesce(html, '')[1:200000]), 'challenge-platform') OR contains(lower(coalesce(html, '')[1:200000]), 'px-captcha') AS refused FROM c)
"""


@query(_CAPTURES + """SELECT page_id, CASE WHEN refused THEN 'blocked' WHEN away THEN 'skipped' WHEN status >= 400 OR html IS NULL THEN 'failed' ELSE 'ok' END AS outcome,
  CASE WHEN refused THEN 'HTTP ' || status WHEN away THEN 'redirected_third_party' WHEN status >= 400 THEN 'HTTP ' || status WHEN html IS NULL THEN 'no page' END AS reason FROM b""")
def page_class(spark, d):
    c = W.page_class(F.col("status"), F.col("html"), F.col("final_url"), F.lit("no page"), DOMAINS)
    return _captures(spark, d).select("page_id", c.alias("c")).select("page_id", F.col("c.status").alias("outcome"), "c.reason")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Cloudflare challenge (cf-mitigated header)' WHEN contains(lower(html), 'captcha') THEN 'Bot-protection page (contains "captcha")'
  WHEN page_id % 3 = 1 THEN 'Blocked by Akamai (HTTP 429)' END AS protection FROM pages""")
def bot_protection(spark, d):
    k = F.col("page_id")
    headers = F.when(k % 3 == 0, F.create_map(F.lit("cf-mitigated"), F.lit("challenge"))).when(k % 3 == 1, F.create_map(F.lit("server"), F.lit("AkamaiGHost"))).otherwise(F.create_map(F.lit("server"), F.lit("nginx")))
    return E.pages(spark, d).select("page_id", W.bot_protection(F.lit(429), headers, F.col("html")).alias("protection"))


@query()
def page_segments(spark, d):
    return html.page_segments(E.pages(spark, d))


@query()
def page_findings(spark, d):
    """HTML to segments to findings in one plan."""
    s = html.page_segments(E.pages(spark, d)).withColumn("language", F.lit(None).cast("string"))
    return V.evaluate(s, [RULE])


@query("WITH " + _URL.rstrip().rstrip(",") + """
SELECT page_id, CASE WHEN regexp_matches(path || CASE WHEN query = '' THEN '' ELSE '?' || query END, '^/.*ref=') THEN FALSE WHEN starts_with(path, '/fr/8') THEN TRUE ELSE NOT starts_with(path, '/fr/') END AS allowed FROM w""")
def robots_allowed(spark, d):
    p = E.pages(spark, d).select("page_id", "url", "host")
    text = "User-agent: *\nDisallow: /*ref=\nDisallow: /fr/\nAllow: /fr/8\n"
    return robots.with_allowed(p, p.select("host").distinct().withColumn("robots", F.lit(text))).select("page_id", "allowed")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages), m AS (SELECT page_id, href FROM l WHERE contains(lower(href), 'the') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY href) AS k FROM m) SELECT page_id, href FROM r WHERE k <= 5""")
def first_links_of_kind(spark, d):
    """Distinct links that a pattern picks, five a page at most, as terms-of-use links are."""
    l = E.pages(spark, d).select("page_id", F.explode(F.array_distinct(F.filter(W.links(F.col("html")), lambda x: F.lower(x).rlike("the")))).alias("href"))
    return R.capped(l, "page_id", ["href"], 5).where("outcome = 'kept'").select("page_id", "href")


@query("WITH " + _URL + "SELECT host, page_id, CASE WHEN row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3 THEN 'kept' ELSE 'page_limit' END AS outcome FROM w")
def page_limit_cap(spark, d):
    return R.capped(E.pages(spark, d).select("host", "page_id"), "host", ["page_id"], 3)


@query("WITH " + _URL + "SELECT host, least(count(*), 3) AS done, CASE WHEN count(*) >= 3 THEN 'page_limit' END AS stop_reason, 'completed' AS status FROM w GROUP BY 1")
def page_limit_stops(spark, d):
    return R.stop_reasons(E.pages(spark, d), "host", 3)


@query(with_sql("segments") + "SELECT asset_id, segment_id, CASE WHEN row_number() OVER (PARTITION BY asset_id ORDER BY visibility = 'visible' DESC, segment_id) <= 4 THEN 'kept' ELSE 'page_limit' END AS outcome FROM segments")
def priority_cap(spark, d):
    return R.capped(E.segments(spark, d).select("asset_id", "segment_id", "visibility"), "asset_id", [F.col("visibility") != "visible", "segment_id"], 4).drop("visibility")


# --- events, usage, review


@query("""WITH e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS grp FROM e WHERE bad)
SELECT user_id, CAST(min(k) AS INT) AS first_pos, count(*) AS length FROM g GROUP BY user_id, grp HAVING count(*) >= 2""")
def refusal_streaks(spark, d):
    return R.refusal_streaks(E.table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)


@query(with_sql("calls") + "SELECT CAST(created_at AS DATE) AS date, stage, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM calls GROUP BY 1, 2")
def usage_by_day_stage(spark, d):
    c = E.calls(spark, d)
    return c.groupBy(F.to_date("created_at").alias("date"), "stage").agg(n("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"))


@query(with_sql("calls") + """, s AS (SELECT CAST(created_at AS DATE) AS date, stage, count(*) AS c, sum(input_tokens) AS i, sum(output_tokens) AS o, count(*) FILTER (NOT ok) AS f FROM calls GROUP BY 1, 2)
SELECT date, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(f) AS BIGINT) AS failed, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, string_agg(stage || '=' || c, ',' ORDER BY stage) AS stages,
  round(CAST(sum(i) AS DOUBLE) / 1e6 * 0.3 + CAST(sum(o) AS DOUBLE) / 1e6 * 2.5, 4) AS cost FROM s GROUP BY 1""")
def usage_by_day(spark, d):
    u = R.usage(E.calls(spark, d))
    return u.withColumn("stages", F.concat_ws(",", F.transform(F.map_entries("stages"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))))


@query(with_sql("calls") + """, s AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS c, count(*) FILTER (NOT ok) AS f, sum(input_tokens) AS i, sum(output_tokens) AS o FROM calls GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS calls, CAST(sum(f) AS BIGINT) AS failed, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
  round(sum(round(CAST(i AS DOUBLE) / 1e6 * 0.3 + CAST(o AS DOUBLE) / 1e6 * 2.5, 4)), 4) AS cost FROM s""")
def usage_total(spark, d):
    return R.usage_total(R.usage(E.calls(spark, d)))


@query(with_sql("calls") + "SELECT count(*) AS calls_today FROM calls WHERE created_at >= date_trunc('day', (SELECT max(created_at) FROM calls))")
def calls_today(spark, d):
    c = E.calls(spark, d)
    last = c.agg(F.date_trunc("day", F.max("created_at")).alias("since"))
    return c.join(F.broadcast(last), c["created_at"] >= last["since"]).agg(n("calls_today"))  # one row


@query(with_sql("calls") + "SELECT run_id, CAST(date_diff('second', max(created_at), (SELECT max(created_at) FROM calls)) AS BIGINT) AS age, date_diff('second', max(created_at), (SELECT max(created_at) FROM calls)) > 15 AS stale FROM calls GROUP BY 1")
def heartbeat_age(spark, d):
    c = E.calls(spark, d)
    seen = c.groupBy("run_id").agg(F.max(F.date_trunc("second", "created_at")).alias("seen"))
    now = c.agg(F.max(F.date_trunc("second", "created_at")).alias("now"))
    age = F.timestamp_diff("SECOND", F.col("seen"), F.col("now"))
    return seen.crossJoin(F.broadcast(now)).select("run_id", age.alias("age"), (age > 15).alias("stale"))  # one row


_ANSWERS = with_sql("findings") + """, known AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'misspelling' WHEN toxic = 1 THEN 'not_brand' ELSE 'unsure' END AS verdict FROM labels),
c AS (SELECT f.*, k.verdict FROM findings f LEFT JOIN known k ON f.asset_id = k.doc_id WHERE f.status = 'ambiguous')
"""


def _answers(spark, d):
    k = E.table(spark, d, "labels").select(F.col("doc_id").alias("asset_id"), F.when(F.col("quality") == 0, "misspelling").when(F.col("toxic") == 1, "not_brand").otherwise("unsure").alias("verdict"))
    return E.findings(spark, d).where("status = 'ambiguous'").join(k, "asset_id", "left").select("finding_id", "verdict")


@query(_ANSWERS.replace("WITH ", "WITH " + E.SQL["rules"] + ",\n", 1) + """SELECT f.finding_id, coalesce(CASE c.verdict WHEN 'misspelling' THEN 'violation' WHEN 'not_brand' THEN 'dismissed' END, f.status) AS status, CASE WHEN c.verdict = 'misspelling' THEN r.severity ELSE f.severity END AS severity
FROM findings f LEFT JOIN c USING (finding_id) JOIN rules r ON r.rule_id = f.rule_id""")
def review_apply(spark, d):
    """A confirmed misspelling is as severe as its rule."""
    return review.applied(E.findings(spark, d), _answers(spark, d), E.rules(spark)).select("finding_id", "status", "severity")


@query(with_sql("findings", "assets", "rules") + """SELECT f.finding_id, f.matched_text, s.text, a.language, r.name, r.severity FROM findings f JOIN segments s USING (segment_id) JOIN assets a ON a.asset_id = f.asset_id
JOIN rules r ON r.rule_id = f.rule_id WHERE f.status = 'ambiguous'""")
def review_select(spark, d):
    out = review.select_candidates(E.findings(spark, d), E.segments(spark, d), E.assets(spark, d), E.rules(spark))
    return out.select("finding_id", "matched_text", "text", "language", "name", "severity")


@query(_ANSWERS + "SELECT coalesce(verdict, 'unanswered') AS outcome, count(*) AS n FROM c GROUP BY 1")
def review_outcome(spark, d):
    return review.outcome(_answers(spark, d))


_CANDIDATES = with_sql("findings") + """, k AS (SELECT *, CASE WHEN l > 0 THEN '…' ELSE '' END || substring(text, l + 1, r - l) || CASE WHEN r < length(text) THEN '…' ELSE '' END AS context
  FROM (SELECT *, greatest(start - 150, 0) AS l, least(start + length(matched_text) + 150, length(text)) AS r FROM findings WHERE status = 'ambiguous')),
cand AS (SELECT *, sha256(concat_ws(chr(31), 'judge', 'm', 'i', 'Thing', matched_text, context)) AS key FROM k)
"""


def _cands(spark, d):
    return review.candidates(E.findings(spark, d), "m", "i", "Thing")


@query(_CANDIDATES + "SELECT finding_id, context, key FROM cand")
def candidate_key(spark, d):
    return _cands(spark, d).select("finding_id", "context", "key")


@query(_CANDIDATES + ", known AS (SELECT DISTINCT key FROM cand WHERE asset_id % 3 = 0) SELECT finding_id, key IN (SELECT key FROM known) AS from_cache FROM cand")
def review_cache_split(spark, d):
    c = _cands(spark, d)
    kept = c.where("asset_id % 3 = 0").select("key").distinct().withColumn("verdict", F.lit("unsure"))
    hit, pending = review.split_known(c, kept)
    return hit.select("finding_id", F.lit(True).alias("from_cache")).unionByName(pending.select("finding_id", F.lit(False).alias("from_cache")))


@query(with_sql("findings") + f"""SELECT finding_id, run_id, CAST((row_number() OVER w - 1) // {REVIEW_BATCH} AS BIGINT) AS batch, CAST((row_number() OVER w - 1) % {REVIEW_BATCH} + 1 AS INT) AS number FROM findings WHERE status = 'ambiguous' WINDOW w AS (PARTITION BY run_id ORDER BY finding_id)""")
def review_batches(spark, d):
    return review.batches(E.findings(spark, d).where("status = 'ambiguous'"), by="run_id").select("finding_id", "run_id", "batch", "number")


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def prompt_escape(spark, d):
    return E.table(spark, d, "documents").select("doc_id", T.escaped(F.col("text")).alias("escaped"))


@query(with_sql("segments") + "SELECT DISTINCT text_source, CASE WHEN text_source LIKE 'meta:%' THEN 'meta ' || substring(text_source, 6) ELSE replace(text_source, '_', ' ') END AS label FROM segments")
def source_labels(spark, d):
    return E.segments(spark, d).select("text_source").distinct().withColumn("label", T.source_label(F.col("text_source")))


# --- dimensions and storage


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'needs_preflight' WHEN c_custkey % 5 = 0 THEN 'stale' WHEN c_custkey % 3 = 0 THEN 'blocked' WHEN c_custkey % 2 = 0 THEN 'needs_ack' ELSE 'ready' END AS readiness FROM customer""")
def readiness_ladder(spark, d):
    k = F.col("c_custkey")
    s = E.table(spark, d, "customer").select(
        k, F.when(F.col("c_acctbal") < 0, None).otherwise(k % 3 != 0).alias("can_crawl"), F.when(k % 5 == 0, "old").otherwise("now").alias("checked_fingerprint"), F.lit("now").alias("fingerprint"), F.when(k % 2 == 0, None).otherwise("t").alias("acknowledged_at")
    )
    return R.readiness(s).select("c_custkey", "readiness")


@query("SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def dimension_lookup(spark, d):
    c, nat, reg = (E.table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(nat, c["c_nationkey"] == nat["n_nationkey"], "left").join(reg, nat["n_regionkey"] == reg["r_regionkey"], "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT p_partkey, coalesce(n, p) AS p_name FROM (SELECT p_partkey, p_name AS p FROM part) LEFT JOIN (SELECT p_partkey, upper(p_name) AS n FROM part WHERE p_partkey % 4 = 0) USING (p_partkey)""")
def upsert_latest(spark, d):
    """Stored in buckets; the buckets that new rows fall into are rewritten."""
    old, path = E.table(spark, d, "part").select("p_partkey", "p_name"), storage.fresh_path(spark, "parts")
    storage.upsert(old, path, "p_partkey")
    storage.upsert(old.where("p_partkey % 4 = 0").select("p_partkey", F.upper("p_name").alias("p_name")), path, "p_partkey")
    return storage.upserted(spark, path)


@query("SELECT l_partkey AS rule_id, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY 1")
def next_versions(spark, d):
    return E.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("rule_id")).agg((F.max("l_linenumber") + 1).alias("next_version"))


@query("""WITH i AS (SELECT p_partkey, unnest(string_split(p_type || ' , ' || p_brand || ',' || p_type, ',')) AS raw, generate_subscripts(string_split(p_type || ' , ' || p_brand || ',' || p_type, ','), 1) AS k FROM part),
f AS (SELECT p_partkey, trim(raw) AS item, min(k) AS k FROM i WHERE trim(raw) <> '' GROUP BY 1, 2) SELECT p_partkey, string_agg(item, '|' ORDER BY k) AS items FROM f GROUP BY 1""")
def list_clean(spark, d):
    raw = F.split(F.concat("p_type", F.lit(" , "), "p_brand", F.lit(","), "p_type"), ",")
    return E.table(spark, d, "part").select("p_partkey", F.concat_ws("|", T.list_clean(raw)).alias("items"))


@query("SELECT event_id, event_type, CAST(value AS DOUBLE) AS value, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, d):
    return E.table(spark, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))


@query(with_sql("findings") + "SELECT status, sum(CASE WHEN kind = 'casing' THEN 1 ELSE 0 END)::BIGINT AS casing, sum(CASE WHEN kind = 'attached' THEN 1 ELSE 0 END)::BIGINT AS attached, sum(CASE WHEN kind = 'near_miss' THEN 1 ELSE 0 END)::BIGINT AS near_miss FROM findings GROUP BY 1")
def outcome_pivot(spark, d):
    f = E.findings(spark, d).where("kind IN ('casing', 'attached', 'near_miss')")
    return f.groupBy("status").pivot("kind", ["casing", "attached", "near_miss"]).agg(n()).na.fill(0)


@query(with_sql("findings", "assets") + """, dep AS (SELECT asset_id, count(*) AS c FROM findings WHERE status = 'violation' GROUP BY 1)
SELECT a.status AS outcome, a.kind, count(*) AS assets, CAST(coalesce(sum(c), 0) AS BIGINT) AS violations FROM assets a LEFT JOIN dep USING (asset_id) GROUP BY 1, 2""")
def file_outcomes(spark, d):
    dep = E.findings(spark, d).where("status = 'violation'").groupBy("asset_id").agg(n("c"))
    return E.assets(spark, d).join(dep, "asset_id", "left").groupBy(F.col("status").alias("outcome"), "kind").agg(n("assets"), F.coalesce(F.sum("c"), F.lit(0)).alias("violations"))


@query(with_sql("rows") + """SELECT finding_id, '{"id":' || finding_id || ',"kind":"' || kind || '","asset":{"id":' || asset_id || ',"url":"' || url || '"}}' AS json FROM rows""")
def findings_json(spark, d):
    said = F.to_json(F.struct(F.col("finding_id").alias("id"), "kind", F.struct(F.col("asset_id").alias("id"), "url").alias("asset")))
    return E.rows(spark, d).select("finding_id", said.alias("json"))


@query("SELECT item_id, sha256('m' || 'judge' || 'instructions' || text) AS key, '••••' || right(sha256(text), 4) AS masked FROM benchmark")
def answer_keys(spark, d):
    return E.table(spark, d, "benchmark").select("item_id", T.digest_of(F.lit("m"), F.lit("judge"), F.lit("instructions"), F.col("text")).alias("key"), T.masked_key(F.sha2(F.col("text").cast("binary"), 256)).alias("masked"))


@query(with_sql("segments") + """SELECT run_id, string_agg(k || '=' || n, ',' ORDER BY k) AS merged FROM (SELECT run_id, visibility AS k, count(*) AS n FROM segments WHERE visibility <> 'hidden' GROUP BY 1, 2
UNION ALL SELECT DISTINCT run_id, 'hidden', 0 FROM segments) GROUP BY 1""")
def stats_merged(spark, d):
    """Counters merged into stored ones, the newer value of a key winning: pairs in, a map out."""
    seen = E.segments(spark, d).groupBy("run_id", F.col("visibility").alias("k")).agg(n("v")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("old"))
    new = F.create_map(F.lit("hidden"), F.lit(0).cast("long"))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(new, k)), new)
    said = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return seen.select("run_id", F.concat_ws(",", said).alias("merged"))


@query(with_sql("findings", "assets") + """, c AS (SELECT run_id, count(*) FILTER (kind = 'page' AND status = 'ok') AS pages, count(*) FILTER (kind = 'pdf' AND status = 'ok') AS files FROM assets GROUP BY 1),
f AS (SELECT run_id, count(*) FILTER (status = 'violation') AS v, count(*) FILTER (status = 'ambiguous') AS a FROM findings GROUP BY 1)
SELECT run_id, pages || ' pages and ' || files || ' PDFs read, ' || n || ' text segments; ' || v || ' violations, ' || a || ' to review' AS sentence
FROM c JOIN f USING (run_id) JOIN (SELECT run_id, count(*) AS n FROM segments GROUP BY 1) USING (run_id)""")
def run_sentences(spark, d):
    ok = F.col("status") == "ok"
    c = E.assets(spark, d).groupBy("run_id").agg(F.count_if(ok & (F.col("kind") == "page")).alias("pages"), F.count_if(ok & (F.col("kind") == "pdf")).alias("files"))
    f = E.findings(spark, d).groupBy("run_id").agg(F.count_if(F.col("status") == "violation").alias("v"), F.count_if(F.col("status") == "ambiguous").alias("a"))
    s = E.segments(spark, d).groupBy("run_id").agg(n())
    return c.join(f, "run_id").join(s, "run_id").select("run_id", F.format_string("%d pages and %d PDFs read, %d text segments; %d violations, %d to review", "pages", "files", "n", "v", "a").alias("sentence"))


@query(_ANSWERS + """, done AS (SELECT f.asset_id, f.segment_id, coalesce(CASE c.verdict WHEN 'misspelling' THEN 'violation' WHEN 'not_brand' THEN 'dismissed' END, f.status) AS status FROM findings f LEFT JOIN c USING (finding_id))
SELECT asset_id, count(*) FILTER (status = 'violation') AS violations, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'dismissed') AS dismissed FROM done GROUP BY 1""")
def counts_after_review(spark, d):
    """What a run's summary says once verdicts are taken over."""
    done = review.applied(E.findings(spark, d), _answers(spark, d), E.rules(spark))
    one = lambda v: F.count_if(F.col("status") == v)
    return done.groupBy("asset_id").agg(one("violation").alias("violations"), one("ambiguous").alias("ambiguous"), one("dismissed").alias("dismissed"))


@query(with_sql("findings") + "SELECT segment_id, text_source FROM segments WHERE text_source IN ('text', 'heading') AND segment_id IN (SELECT segment_id FROM findings)")
def segments_with_findings(spark, d):
    s = E.segments(spark, d).where(F.col("text_source").isin("text", "heading"))
    return s.join(E.findings(spark, d).select("segment_id"), "segment_id", "left_semi").select("segment_id", "text_source")


def queries() -> dict[str, Query]:
    return QUERIES | kernel.QUERIES | steps.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | kernel.SQL | steps.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to segments to findings to scores, per language."""
    assets = E.assets(spark, sf_dir)
    found = V.evaluate_run(E.segments(spark, sf_dir), assets, [RULE])
    scores = R.asset_scores(found, assets).join(V.with_language(assets).select("asset_id", "language"), "asset_id")
    return scores.groupBy("run_id", "language").agg(n("assets"), F.avg("score").alias("score"), F.sum("violations").alias("violations"))
