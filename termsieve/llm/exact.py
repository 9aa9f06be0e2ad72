"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

The rows of an input partition are a run of (digest, largest id, rows). Runs meet in binomial rounds:
in each, FAN runs with neighbouring numbers exchange their slices (ranges of the digest), a task
puts the FAN sorted runs of a slice in one order, and a pass over equal neighbours merges them and
retains the verified id of the row that stays. In the plan of a round these are an exchange by (run,
slice), a sort and a sort-based aggregate; no hash table is built. Before the last round a digest that holds
a third of all rows is a row for every run, spread over the tasks of these runs, and in the last
FAN rows. SHA-256, byte length and a 64-bit checksum of the normalised text must all agree for two
rows to count as equal.

Defined results: null text is the empty text; a null id is never preferred to another; repeated
rows are members of the same group (of rows that share the kept id and text, all are marked kept);
an empty table gives an empty result; extra columns of any name are kept by `without_copies` and
ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise, spare, text_rows

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. For pure ASCII the quick lower() is the same function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    norm = text_rows(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return norm.select(
        "doc_id",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
    )


KEY = ["digest", "n_bytes", "check"]
SORTED = "spark.sql.execution.replaceHashWithSortAgg"


def merge_round(runs: DataFrame, keep_largest: bool, slices: int) -> DataFrame:
    """FAN neighbouring runs to one: the exchange of slices, the order of the runs, the merge of equal neighbours,
    of which the last (or first that is not null) has the id that stays."""
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    dealt = runs.withColumns({"run": F.floor(F.col("run") / FAN).cast("int"), "slice": F.shiftright(lead * slices, 32).cast("int")})
    ordered = dealt.repartition("run", "slice").sortWithinPartitions("run", "slice", *KEY, "keep_id")
    stays = F.last("keep_id") if keep_largest else F.first("keep_id", ignorenulls=True)
    merged = ordered.groupBy("run", "slice", *KEY).agg(stays.alias("keep_id"), F.sum("group_size").alias("group_size"))
    return merged.drop("slice")


def tree_merge(rows: DataFrame, runs: int, keep_largest: bool = True) -> DataFrame:
    """One row per digest: the id of the row that stays and the size of its group. rows: (run, digest, ...)."""
    conf = rows.sparkSession.conf
    slices = int(conf.get("spark.sql.shuffle.partitions"))
    merged = rows.select("run", *KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    while True:
        merged = merge_round(merged, keep_largest, slices)
        runs = -(-runs // FAN)
        if runs == 1:
            break
    # Equal neighbours of sorted rows are merged as they pass by; the plan is made while this is set.
    before = conf.get(SORTED, "false")
    conf.set(SORTED, "true")
    try:
        return materialise(merged.drop("run"))
    finally:
        conf.set(SORTED, before)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = True) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digests(docs, id_col, text_col))
    winners = tree_merge(rows, runs_of(rows), keep_largest)
    joined = rows.drop("run").join(winners, KEY)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that stay: one of each group of equal texts.

    Rows are fetched by id and checksum, not by digest, so the texts of a large group never meet.
    """
    rows = materialise(digests(docs))
    stay = tree_merge(rows, runs_of(rows))
    id_, null, norm = (spare(docs, c) for c in ("id", "null", "norm"))
    key = lambda c: (F.coalesce(c, F.lit(0)), c.isNull())
    stay = stay.select(*(k.alias(n) for k, n in zip(key(F.col("keep_id")), (id_, null))), F.col("check").alias(norm))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.withColumns({**dict(zip((id_, null), key(F.col("doc_id").cast("long")))), norm: F.xxhash64(ascii_lower(text))})
    # The join and the choice of one of repeated rows share an exchange.
    return one.join(stay, [id_, null, norm], "left_semi").dropDuplicates([id_, null, norm]).select(*docs.columns)


def runs_of(rows: DataFrame) -> int:
    """How many runs the rows are of, from their numbers."""
    last = rows.agg(F.max("run")).first()[0]
    return 1 if last is None else last + 1
