"""URL filters: given rules of host and path, and for other urls rules that FP-growth mines from labelled ones.

A url is a set of tokens: its scheme, the labels of its host by their place from the right, its path segments (numbers as #), the
ending of the last one and the names of its query. Spark's FP-growth finds the token sets that at least `support` of the
labelled urls (and LEAST of them) have together with the mark of a bad one; a set is a rule if at least `confidence` of the
labelled urls that have it are bad, and if no subset is a rule with the same confidence or more. A url is blocked if it has
all tokens of a rule. Matching counts, over an inverted index from tokens to rules, how many of a rule's tokens a url has, so
work follows the rules that share a token with the url.

Mining reads all labelled urls and every token that enough bad ones have. Tokens that exactly the same labelled urls have (by count
and two sums of 64-bit hashes) are mined as one, since they can stand for each other in any rule; a rule is written out with each of
them where that makes at most MOST rules, else its item is the set of tokens of which a url must have one. No token, url or rule is
left out, so urls with very many tokens that are common and all apart make very many rules. Matching takes every token of every url.

Defined results: a null url, or one without `://`, has empty host and path, no tokens and the verdict allow unless a rule
fits; a label that is not 0 or 1 is none; of several labels of a page the worse counts; repeated rows are
judged alike; without labels, or with few, nothing is mined; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from itertools import combinations, product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, bounded
from .exact import ascii_lower

#: Part of the labelled urls, and labelled urls, that have all tokens of a rule and are bad; part of those with the tokens that are bad.
SUPPORT, LEAST, CONFIDENCE = 0.005, 20, 0.75
#: Rules that one rule is written out to, at most, for tokens that stand for each other.
MOST = 10
BAD = "bad"
#: Token sets whose verdict a task keeps.
KNOWN = 1 << 16
#: The number that a path ends in.
NUMBER = r"(?:^|/)(\d{1,18})(?:\.[A-Za-z]+)?/?$"

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: A token, or a set of them of which a url must have one.
Item = str | frozenset[str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path."""
    piece = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(piece(1)), piece(2)


def fitting(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule (verdict, rule) that a url fits, else null. For lists that are short enough to be an expression."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a url's tokens, in order."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = lambda x: F.regexp_replace(x, r"\d+", "#")
    ending = F.regexp_extract(path, r"\.([A-Za-z][0-9A-Za-z]{0,9})$", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), plain(x))),
        F.transform(steps, lambda x: F.concat(F.lit("path:"), plain(x))),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), F.lower(ending)))).otherwise(F.array().cast("array<string>")),
        F.transform(names, lambda x: F.concat(F.lit("query:"), plain(x))),
    )
    return F.when(F.contains(url, F.lit("://")), F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def common(marked: DataFrame, need: int) -> DataFrame:
    """(token, stands): the tokens that enough bad urls have, and the least one of those that the same urls have."""
    rows = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    seen = marked.select("row", F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *rows)
    alike = seen.where(F.col("n_bad") >= need).groupBy("n", "h0", "h1").agg(F.collect_list("token").alias("some"))
    return alike.select(F.explode("some").alias("token"), F.array_min("some").alias("stands"))


def written_out(rule: frozenset[str], alike: dict[str, list[str]], most: int) -> list[frozenset[Item]]:
    """A rule of tokens that stand for others, with each of these in turn, or where that makes many with sets of them."""
    if math.prod(len(alike[t]) for t in rule) <= most:
        return [frozenset(some) for some in product(*(alike[t] for t in rule))]
    return [frozenset(frozenset(alike[t]) if len(alike[t]) > 1 else t for t in rule)]


def mined(marked: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, most: int = MOST) -> dict[frozenset[Item], float]:
    """The rules of labelled urls, and their confidence. marked: url, bad."""
    spark, scratch = marked.sparkSession, Scratch(marked.sparkSession)
    try:
        cut = tokens(F.col("url"), *parts(F.col("url")))
        marked = scratch.keep(marked.select(F.monotonically_increasing_id().alias("row"), cut.alias("tokens"), "bad"), "labelled")
        n, n_bad = marked.agg(F.count(F.lit(1)), F.count_if("bad")).first()
        need = max(least, math.ceil(support * n))
        if n_bad < need:
            return {}
        # A token that too few bad urls have is in no rule, so tokens of all urls / need are left at most.
        stand = scratch.keep(common(marked, need), "stand")
        told = marked.select("row", "bad", F.explode("tokens").alias("token")).join(stand, "token")
        items = told.groupBy("row", "bad").agg(F.collect_set("stands").alias("items"))
        items = scratch.keep(items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "items")
        rows = items.count()
        if not rows:
            return {}
        # Half a row less, so that `need` rows suffice whatever the rounding.
        model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / rows, minConfidence=confidence).fit(items)
        found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select("antecedent", "confidence").collect()
        alike = {r.stands: sorted(r.some) for r in stand.groupBy("stands").agg(F.collect_list("token").alias("some")).collect()} if found else {}
    finally:
        scratch.drop()
    return {x: c for r, c in pruned({frozenset(a): c for a, c in found}).items() for x in written_out(r, alike, most)}


def pruned(rules: dict[frozenset[str], float]) -> dict[frozenset[str], float]:
    """Without rules that a rule of fewer of their tokens makes needless: one of the same confidence or more."""
    inside = lambda r: (frozenset(s) for k in range(1, len(r)) for s in combinations(r, k))
    return {r: c for r, c in rules.items() if not any(rules.get(s, -1.0) >= c for s in inside(r))}


class Index:
    """From tokens to the rules, and items of them, that they meet."""

    def __init__(self, rules: Iterable[frozenset[Item]]):
        self.sizes, self.of = [], defaultdict(list)
        for k, rule in enumerate(rules):
            self.sizes.append(len(rule))
            for i, item in enumerate(rule):
                for token in (item,) if isinstance(item, str) else item:
                    self.of[token].append((k, i))

    def matches(self, tokens: Iterable[str]) -> bool:
        """Whether these tokens meet all items of some rule."""
        met = defaultdict(set)
        for t in set(tokens):
            for k, i in self.of.get(t, ()):
                met[k].add(i)
        return any(self.sizes[k] == len(items) for k, items in met.items())


def judge(urls: DataFrame, given: Iterable[Rule], rules: Iterable[frozenset[Item]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (the longest given one that fits, else null) and verdict."""
    host, path = parts(F.col("url"))
    rows = bounded(urls).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("by", fitting(F.col("host"), F.col("path"), given))
    rules = list(rules)
    if not rules:
        return rows.select("page_id", "host", "path", "by.rule", F.coalesce("by.verdict", F.lit("allow")).alias("verdict"))
    shared = urls.sparkSession.sparkContext.broadcast(Index(rules))
    left = F.when(F.col("by").isNull(), tokens(F.col("url"), F.col("host"), F.col("path")))

    def run(batches):
        index, known = shared.value, {}
        for batch in batches:
            verdict = []
            for by, some in zip(batch.column("verdict").to_pylist(), batch.column("tokens").to_pylist()):
                if by is None:
                    key = tuple(some or ())
                    if key not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[key] = "block" if index.matches(key) else "allow"
                    by = known[key]
                verdict.append(by)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    rows = rows.select("page_id", "host", "path", "by.rule", "by.verdict", left.alias("tokens"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document has a label: a page's url ends in the number of its document. A
    document is bad if its quality is 0 or it is toxic."""
    flag = lambda c, v: F.when(F.col(c).isin(0, 1), F.col(c) == v)
    bad = F.coalesce(flag("quality", 0) | flag("toxic", 1), flag("quality", 0), flag("toxic", 1))
    known = labels.select(F.col("doc_id").cast("long").alias("number"), bad.alias("bad")).where("number IS NOT NULL AND bad IS NOT NULL").groupBy("number").agg(F.max("bad").alias("bad"))
    url = F.col("url").cast("string")
    number = F.nullif(F.regexp_extract(parts(url)[1], NUMBER, 1), F.lit("")).cast("long")
    return pages.select(url.alias("url"), number.alias("number")).where("number IS NOT NULL").join(known, "number").select("url", "bad")


def filter_urls(pages: DataFrame, labels: DataFrame, given: Iterable[Rule]) -> DataFrame:
    return judge(pages, given, mined(labelled(pages, labels)))
