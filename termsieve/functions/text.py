"""Column functions over text."""

from __future__ import annotations

import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spelling import ZERO_WIDTH

#: White space of either engine's patterns, spelled out.
SPACE = r"[ \t\n\r\f\x0B]"
WORD = r"\p{L}+"
MOST_CHARS = 5000


def squeezed(c: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean(c: Column, most: int = MOST_CHARS) -> Column:
    """The same, cut to `most` characters: what a page's segment may have."""
    return F.substring(squeezed(c), 1, most)


def folded(c: Column) -> Column:
    """For comparison without case: two texts are equal after it where they are after full case folding
    (ß and ss, every sigma). Dotless i, which upper case would join with i, is kept apart."""
    sigma = lambda x: F.translate(x, "ς", "σ")  # noqa: E731  (it also keeps Spark from dropping the inner conversions)
    plain = F.replace(c, F.lit("ı"), F.lit("\ue000"))
    return F.replace(sigma(F.lower(sigma(F.upper(sigma(F.lower(plain)))))), F.lit("\ue000"), F.lit("ı"))


def _usual() -> str:
    """The body of a character class: what the exact check's folding leaves alone and whose case every engine folds
    alike. Signs and Latin letters with one compatibility form, themselves; sharp s is dealt with by `lowered`."""

    def same(c: str) -> bool:
        one_case = c == "ß" or c not in "ıİ" and len(c.casefold()) == 1 and c.casefold() == c.lower() and len(c.upper()) == 1
        return c not in ZERO_WIDTH and unicodedata.normalize("NFKC", c) == c and (not c.isalpha() or one_case)

    points = [n for n in chain(range(0xA1, 0x250), range(0x2010, 0x2028), (0x20AC,)) if same(chr(n))]
    first = [n for n in points if n - 1 not in points]
    last = [n for n in points if n + 1 not in points]
    return r"\x00-\x7F" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(first, last))


USUAL = _usual()


def unusual(c: Column) -> Column:
    """Whether a text has characters that built-in functions do not fold as the exact check does."""
    return (F.octet_length(c) != F.char_length(c)) & F.rlike(c, F.lit(f"[^{USUAL}]"))


def lowered(c: Column) -> Column:
    """Case folding of a text that is not unusual."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def lines(c: Column) -> Column:
    """Lines that hold more than white space."""
    return F.filter(F.split(c, r"[\r\n]"), lambda x: F.trim(x) != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def market_of_language(c: Column) -> Column:
    tag = F.regexp_replace(F.lower(F.trim(c)), "_", "-")
    chinese = F.when(tag.rlike("hant|-tw|-hk|-mo"), "zh-Hant").otherwise("zh-Hans")
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(tag.startswith("zh"), chinese).otherwise(F.nullif(F.substring_index(tag, "-", 1), F.lit("")))


def snippet(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """The characters around [start, end), with an ellipsis where text was left out."""
    left, right = F.greatest(start - width, F.lit(0)), F.least(end + width, F.char_length(text))
    return F.concat(F.when(left > 0, "…").otherwise(""), F.substring(text, left + 1, right - left), F.when(right < F.char_length(text), "…").otherwise(""))


def occurrences(text: Column, word: Column) -> Column:
    """The text cut at every occurrence of a word: what stands before, between and after them."""
    pattern = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(word == "", F.array(text)).otherwise(F.split(text, pattern))


def escaped(c: Column) -> Column:
    """For markup: & < > and both quotes."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def closed_references(c: Column) -> Column:
    """Markup in which a character reference without its semicolon (where a text was cut) is plain text."""
    return F.regexp_replace(c, r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);)", "&amp;")


def masked_key(c: Column) -> Column:
    return F.concat(F.lit("••••"), F.right(c, F.lit(4)))


def source_label(c: Column) -> Column:
    """A text source in words: `attr:alt` is `alt attribute`, `meta:x` is `meta x`."""
    rest = F.substring_index(c, ":", -1)
    return F.when(c.startswith("attr:"), F.concat(rest, F.lit(" attribute"))).when(c.startswith("meta:"), F.concat(F.lit("meta "), rest)).when(c.startswith("pdf_meta:"), F.concat(F.lit("PDF "), rest)).otherwise(F.replace(c, F.lit("_"), F.lit(" ")))


def digest_of(*parts: Column, separator: str = "") -> Column:
    """A null part is an empty one, so that the parts after it keep their places."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def list_clean(c: Column) -> Column:
    """Stripped, without empty items, first occurrence of each."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def exactly_rounded(c: Column, digits: int) -> Column:
    """The same for a column, of few rows: built-in rounding goes by the decimal digits that a number is shown with."""
    return F.arrow_udf(lambda some: pa.array([exact_round(v, digits) for v in some.to_pylist()], pa.float64()), "double")(c)


def exact_round(value: float | None, digits: int) -> float | None:
    """Rounding of the exact binary value, half to even: on the driver, for single results."""
    return None if value is None else round(value, digits)
