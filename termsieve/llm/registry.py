"""Queries over whole tables, one per operator, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, exact, lm, nbsvm, packing, resample, rules, simhash, suffix, urls, warc
from .base import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are; the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_report(table(spark, sf_dir, "documents"))


def op3_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


HARD = "\\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.turns_of_table(table(spark, sf_dir, "conversations"))
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return chat.read_back(chat.format_pieces(turns.unionByName(hard)))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


#: (verdict, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the quality rules that SQL can express."""
    return op10_quality_rules(spark, sf_dir).drop("quality_score", "kept")


EXACT_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""

#: Every 400-byte string of every text by its MD5, in pieces so that substrings are taken from near the start.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, b, substring(h, CAST(2 * b + 1 AS BIGINT), 1798) AS t FROM (SELECT rid, h, unnest(generate_series(0, length(h) // 2 - 400, 500)) AS b FROM d WHERE length(h) >= 800)),
w AS (SELECT rid, b + k AS s, md5_number(substring(t, CAST(2 * k + 1 AS BIGINT), 800)) AS m FROM (SELECT rid, b, t, unnest(generate_series(0, length(t) // 2 - 400)) AS k FROM p)),
r AS (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS before FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT rid, s, sum(CASE WHEN s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS run FROM r),
spans AS (SELECT rid, run, min(s) AS lo, max(s) + 400 AS hi FROM g GROUP BY 1, 2),
cut AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS last FROM spans),
kept AS (SELECT rid, string_agg(substring(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (lo - last) AS BIGINT)), '' ORDER BY lo) AS k, max(hi) AS hi, sum(hi - lo) AS removed, count(*) AS n FROM cut JOIN d USING (rid) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE k || substring(h, CAST(2 * hi + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

COUNTS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
i AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM w),
g AS (SELECT rid, k, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s || ' ' || lead(w, 3) OVER s || ' ' || lead(w, 4) OVER s AS g FROM i WINDOW s AS (PARTITION BY rid ORDER BY k)),
r AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT k + o) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY 1),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN n USING (rid) LEFT JOIN l USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + 2 * length(role) - length(regexp_replace(role, '[\\#<:]', '', 'g'))
              + 2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


#: A register takes a byte at a time: its table is made by eight halvings of each of 256 values.
RESAMPLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
step AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT rid, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda k: 16 * (strpos('0123456789ABCDEF', x[k]) - 1) + strpos('0123456789ABCDEF', x[k + 1]) - 1),
    lambda c, v: xor(c >> 8, tab[xor(c, v) % 256 + 1])), 4294967295) % 10000 AS bucket FROM h, step),
s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY 1),
gain AS (
  SELECT hashed.bucket, any_value(CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT)) AS g
  FROM hashed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket) GROUP BY 1),
mean AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT rid, doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (rid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER (PARTITION BY enough) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND k <= 25 * n // 100 THEN k END AS rank FROM ranked
"""


def _code_rounds() -> str:
    """Two rounds and the last assignment; entries are rows (part, entry, components)."""
    out = []
    for k in range(3):
        out.append(f"""
near{k} AS (
  SELECT v.rid, v.p, arg_min(b.e, (d, b.e)) AS e, min(d) AS d, any_value(v.x) AS x
  FROM (SELECT v.*, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part v JOIN book{k} b USING (p)) b JOIN part v USING (rid, p) GROUP BY 1, 2)""")
        if k < 2:
            out.append(f"""
moved{k} AS (
  SELECT p, e, list(CAST(floor(m) AS BIGINT) ORDER BY i) AS x
  FROM (SELECT p, e, i, sum(x[i])::DOUBLE / count(*) AS m FROM near{k}, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN moved{k} m USING (p, e))""")
    return ",".join(out)


CODES_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT rid, p, x[4 * p + 1 : 4 * p + 4] AS x FROM v, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, rid - 1 AS e, x FROM part WHERE rid <= 64),{_code_rounds()},
coded AS (SELECT rid, string_agg(substring('0123456789abcdef', CAST(e // 16 + 1 AS BIGINT), 1) || substring('0123456789abcdef', CAST(e % 16 + 1 AS BIGINT), 1), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM v JOIN coded USING (rid)
"""

#: Rules need no pruning here: a url that matches a pruned one matches the one that makes it needless.
URLS_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
given(verdict, h, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT rid, arg_max(verdict, length(h || start)) AS verdict, arg_max(h || start, length(h || start)) AS rule FROM p JOIN given ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY 1),
labels_of AS (SELECT list_filter(list_reverse(string_split(host, '.')), lambda x: x <> '') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps, regexp_extract(path, '\.([A-Za-z][0-9A-Za-z]{0,9})$', 1) AS ending,
    list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> '') AS names, * FROM p),
cut AS (
  SELECT *, CASE WHEN contains(url, '://') THEN list_distinct(['scheme:' || lower(regexp_extract(url, '^(.*?)://', 1, 's'))]
    || list_transform(range(1, len(labels) + 1), lambda k: 'host' || CAST(k - 1 AS VARCHAR) || ':' || regexp_replace(labels[k], '\d+', '#', 'g'))
    || list_transform(steps, lambda x: 'path:' || regexp_replace(x, '\d+', '#', 'g')) || CASE WHEN ending <> '' THEN ['ending:' || lower(ending)] ELSE [] END
    || list_transform(names, lambda x: 'query:' || regexp_replace(x, '\d+', '#', 'g'))) ELSE [] END AS tokens FROM labels_of),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IN (0, 1) OR toxic IN (0, 1)) GROUP BY 1),
marked AS (SELECT rid, tokens, bad FROM cut JOIN known ON doc_id = TRY_CAST(regexp_extract(path, '(?:^|/)(\d{1,18})(?:\.[A-Za-z]+)?/?$', 1) AS BIGINT)),
need AS (SELECT greatest(20, ceil(0.005 * count(*))) AS need FROM marked),
often AS (SELECT token FROM (SELECT unnest(tokens) AS token, bad FROM marked), need GROUP BY token, need HAVING sum(bad) >= need),
told AS (SELECT rid, any_value(bad) AS bad, list(token ORDER BY token) AS items FROM (SELECT rid, bad, unnest(tokens) AS token FROM marked) JOIN often USING (token) GROUP BY 1),
subsets AS (SELECT bad, list_filter(items, lambda x, k: (m >> (k - 1)) & 1 = 1) AS rule FROM (SELECT bad, items, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS m FROM told)),
mined AS (SELECT rule FROM subsets, need GROUP BY rule, need HAVING sum(bad) >= need AND sum(bad) >= 0.75 * count(*)),
met AS (SELECT DISTINCT rid FROM cut JOIN mined ON list_has_all(tokens, rule))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN met.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (rid) LEFT JOIN met USING (rid)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_arc_to_warc, op2_suffix_dedup, op3_naive_bayes_svm, op4_deleted_interpolation, op5_simhash_groups, op6_exact_dedup, op7_byte_bpe, op8_chat_formatting, op9_sum_of_squares_packing, op10_quality_rules, op11_importance_resampling, op12_vector_codes, op13_url_rules, quality_rule_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_arc_to_warc": WARC_SQL, "op2_suffix_dedup": REPEATS_SQL, "quality_rule_counts": COUNTS_SQL, "op6_exact_dedup": EXACT_SQL, "op8_chat_formatting": CHAT_SQL, "op11_importance_resampling": RESAMPLE_SQL, "op12_vector_codes": CODES_SQL, "op13_url_rules": URLS_SQL}
