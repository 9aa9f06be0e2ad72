"""Segments against many rules: an index of names and listed spellings, joined on hashed keys of the distinct words.

A rule can only find something in a text that has certain words: one that contains the name, one that is listed, one
within reach of the name, the longer half of a name in two words, or the longest word of a listed phrase. The index holds
these under hashed keys: a word as it is, the substrings of a word that are as long as a name, and its deletion
neighbours (two words within d edits share what is left after at most d deletions from each). Keys are made of the
distinct words of all texts, once each, so matching words with rules does not grow with texts times rules. A text then meets
only the rules that its words meet; where more than the word is known to be needed (a half, a phrase), the text must have that too.

The exact check decides; everything before it is a superset, whatever the number of rules. Words that meet a rule are written to
the shared folder, so Spark knows their size and broadcasts them only if they are few.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RuleConfig, RuleVersion
from ..functions.spelling import SEPARATORS, SHORTEST_NEAR_MISS, WORD, fold, is_latin
from ..functions.text import lowered, unusual
from .evaluate import BLANKS, INNER_URL, checked_rows, of_interest
from .storage import kept

#: Kinds of keys: the word, a part of it as long as a name, what deletions leave of it.
WHOLE, INSIDE, NEAR = 0, 1, 2
#: Longer words are cut into overlapping pieces for their substrings.
PIECE = 256

_word = re.compile(WORD)
_inner_url = re.compile(r"(?<=[^\W\d_])(?:https?://|www\.)")
_gaps = re.compile(r"[\s" + re.escape(SEPARATORS) + "]+")


class Entry(NamedTuple):
    """A word of this kind makes a text meet the rule; `needs` must then be in its normalised text."""

    kind: int
    form: str
    rule: int
    needs: str | None = None
    reach: int = 0


def plain(folded: str) -> str:
    """Without case, with one space for every run of white space and separators."""
    return _gaps.sub(" ", folded.casefold())


def entries(config: RuleConfig, rule: int) -> Iterable[Entry]:
    key = config.canonical.casefold()
    whole = lambda form, needs=None: Entry(WHOLE, form, rule, needs)
    if _word.fullmatch(key):
        yield Entry(INSIDE, key, rule)
        for i in range(1, len(key)):
            yield whole(max(key[:i], key[i:], key=len), f"{key[:i]} {key[i:]}")
    if config.fuzzy:
        yield Entry(NEAR, key, rule, None, config.max_edit_distance)
    for spelling in config.disallowed:
        if _word.fullmatch(spelling):
            yield whole(spelling.casefold())
        elif is_latin(spelling):
            yield whole(max(_word.findall(spelling.casefold()), key=len, default=""), plain(spelling).strip())
    for market in config.locales.values():
        for form in (*market.approved, *market.disallowed):
            if not is_latin(form):
                yield whole(next(c for c in form.casefold() if c.isalpha() and ord(c) >= 0x250), plain(form).strip())


def neighbours(form: str, most: int) -> set[str]:
    """What is left of a form after at most `most` deletions."""
    return {"".join(c for i, c in enumerate(form) if i not in out) for n in range(min(most, len(form)) + 1) for out in combinations(range(len(form)), n)}


def index_table(spark, every: list[Entry]) -> DataFrame:
    """(key, kind, form, rule, needs, reach): a row for every entry, for a near miss one for every neighbour."""
    rows = [(e.kind, part, *e[1:]) for e in every for part in sorted(neighbours(e.form, e.reach))]
    names = ("kind", "part", "form", "rule", "needs", "reach")
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
    table = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})
    return spark.createDataFrame(table, "kind int, part string, form string, rule int, needs string, reach int").select(F.xxhash64("kind", "part").alias("key"), "kind", "form", "rule", "needs", "reach")


def keys(word: Column, every: list[Entry]) -> Column:
    """The keys of a word that some entry could have."""
    n = F.char_length(word)
    made = lambda kind, parts: F.transform(parts, lambda p: F.xxhash64(F.lit(kind), p))
    out = [made(WHOLE, F.array(word))]
    sizes = sorted({len(e.form) for e in every if e.kind == INSIDE})
    if sizes:
        starts = F.sequence(F.lit(0), n - 1, F.lit(PIECE))
        pieces = F.when(n <= PIECE, F.array(word)).otherwise(F.transform(starts, lambda i: F.substring(word, i + 1, F.lit(PIECE + sizes[-1]))))
        cut = lambda piece, size: F.when(F.char_length(piece) >= size, F.transform(F.sequence(F.lit(1), F.char_length(piece) - size + 1), lambda i: F.substring(piece, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        parts = F.flatten(F.transform(pieces, lambda piece: F.concat(*(cut(piece, s) for s in sizes))))
        out.append(made(INSIDE, F.array_distinct(parts)))
    near = [e for e in every if e.kind == NEAR]
    if near:
        reach = max(e.reach for e in near)
        without = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
        parts = F.concat(F.array(word), without(word))
        if reach > 1:
            parts = F.concat(parts, F.flatten(F.transform(without(word), without)))
        fits = n.between(max(SHORTEST_NEAR_MISS, min(len(e.form) - e.reach for e in near)), max(len(e.form) + e.reach for e in near))
        out.append(F.when(fits, made(NEAR, F.array_distinct(parts))).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*out)


def meeting(words: DataFrame, every: list[Entry]) -> DataFrame:
    """(word, rule, needs) of the distinct words that meet a rule. words: word."""
    index = index_table(words.sparkSession, every)
    keyed = words.select("word", F.explode(keys(F.col("word"), every)).alias("key"))
    met = keyed.join(index, "key")
    same = (F.col("kind") == WHOLE) & (F.col("word") == F.col("form"))
    inside = (F.col("kind") == INSIDE) & F.contains("word", F.col("form"))
    close = (F.col("kind") == NEAR) & (F.levenshtein("word", F.col("form")) <= 2 * F.col("reach"))
    return met.where(same | inside | close).select("word", "rule", "needs").distinct()


def read(texts: pa.Array) -> pa.Array:
    """Words and normalised text of what the JVM does not fold as the check does; null stays null."""
    words, said = [], []
    for t in texts.to_pylist():
        if t is None:
            words.append(None)
            said.append(None)
            continue
        low = fold(t)[0].casefold()
        words.append(sorted({*_word.findall(low), *_word.findall(_inner_url.sub(r" \g<0>", low)), *(c for c in low if ord(c) >= 0x250 and c.isalpha())}))
        said.append(plain(low))
    return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(said, pa.string())], ["words", "plain"])


def with_words(rows: DataFrame, text: str, everywhere: bool) -> DataFrame:
    """The rows with `__words`, distinct and without case, and `__plain`. everywhere: with the empty word, which all texts have."""
    low, odd, said = lowered(F.col(text)), unusual(F.col(text)), F.arrow_udf(read, "struct<words: array<string>, plain: string>")
    # A text is read once by the function of its kind: the other gets null.
    rows = rows.withColumns({"__read": said(F.when(odd, F.col(text))), "__low": F.when(~odd, low)})
    # Where a url begins within a word, the word counts as a whole and cut there.
    twice = F.when(F.rlike("__low", F.lit(INNER_URL)), F.concat("__low", F.lit(" "), F.regexp_replace("__low", INNER_URL, " $0"))).otherwise(F.col("__low"))
    words = F.coalesce("__read.words", F.array_distinct(F.regexp_extract_all(twice, F.lit(r"\p{L}+"), F.lit(0))))
    words = F.array_append(words, F.lit("")) if everywhere else words
    return rows.withColumns({"__words": words, "__plain": F.coalesce("__read.plain", F.regexp_replace("__low", BLANKS, " "))}).drop("__read", "__low")


def evaluate_many(segments: DataFrame, rules: list[RuleVersion], text: str = "text", language: str = "language", visibility: str | None = "visibility") -> DataFrame:
    """The findings of `evaluate`, for any number of rules. Runs a job that matches words with rules."""
    active = [r for r in rules if r.enabled]
    every = [e for k, r in enumerate(active) for e in entries(r.config, k)]
    names = segments.columns
    rows = with_words(of_interest(segments, text, visibility), text, any(e.form == "" for e in every))
    # Rows are written with a number and their words. Words part from their row with the number alone, since a row
    # beside each of its words grows with the square of a text, and meet it again as the rules that they meet.
    numbered = kept(rows.select(F.monotonically_increasing_id().alias("id"), F.struct(*names).alias("row"), "__plain", "__words"), "rows")
    apart = numbered.select("id", F.explode("__words").alias("word"))
    met = kept(meeting(apart.select("word").distinct(), every), "met")
    pairs = apart.join(met, "word").groupBy("id").agg(F.collect_set(F.struct("rule", "needs")).alias("met"))
    has = F.filter("met", lambda m: m["needs"].isNull() | F.contains("__plain", m["needs"]))
    some = numbered.select("id", "row", "__plain").join(pairs, "id").select("row.*", F.array_distinct(has["rule"]).alias("__rules"))
    return checked_rows(some.where(F.size("__rules") > 0), active, text, language, which="__rules")
