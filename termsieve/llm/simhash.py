"""SimHash fingerprints linked by multi-index hashing, and near-duplicate groups by fingerprints and shared shingles.

Fingerprints are computed in Arrow batches. Equal fingerprints become one class first. Classes are
then matched per segment of the fingerprint: every class puts its segment value into that segment's
table, and looks up the small Hamming ball around it; matches are verified on the complete
distance. Looking up is shared between the two members of a pair by the parity of the segment
(values one bit apart differ in parity): only even ones enumerate the ball, so each pair is found
from one side.

Radius and segments follow the pigeonhole principle: two fingerprints of 64 bits at distance 2 or
less agree to 1 bit in the first half or entirely in the second. A table entry with more than CROWD
classes is not compared pairwise: its members also enumerate the ball of radius 1 in the other half,
and meet there. Two values at distance 2 or less have a neighbour in common, and only so many
different fingerprints can meet at one neighbour, so the work is linear in the classes whatever
family of texts they come from.

Defined results of `link_groups`: null or empty text has fingerprint zero and is linked like any
other; rows of null id take part like all others, and a component's name is the smallest id in it,
null only if all its ids are null; rows that share an id are rows of their own; extra columns are
ignored; an empty table gives an empty result. Those of `near_groups` are stated there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import IdFilter, Scratch, bounded, fresh_path, materialise, spare, swept, text_rows
from .components import components
from .kept import others_go
from .nptext import Chunk, buffers, chunks, mix

SEED = 42
#: Classes of one table entry that are compared pairwise, at most.
CROWD = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every `words`-word shingle of the lower-cased (A-Z) text, space-joined; repeats stay."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in w), dtype=np.int64, count=len(w)))
    starts = np.concatenate([[0], ends[:-1]])
    k = max(1, len(w) - words + 1)
    h = xxhash.xxh64_intdigest
    spans = zip(starts[:k].tolist(), (ends[min(words, len(w)) - 1 :] - 1).tolist())
    return np.fromiter((h(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=k)


def fingerprint(h: np.ndarray, lanes: int = 1) -> bytes:
    """64 * lanes bits, big-endian: a bit is one where over half of the hashes have it.

    Lane 0 is the hash itself; further lanes are mixed from it.
    """
    out = []
    for lane in range(lanes):
        g = h if lane == 0 else mix(h + np.uint64((lane * 0xA24BAED4963EE407) & (2**64 - 1)))
        count = np.zeros(64, dtype=np.int64)
        for i in range(0, len(g), BLOCK):
            count += np.unpackbits(g[i : i + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(g)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw = data.tobytes()
            fp = b"".join([fingerprint(shingle_hashes(raw[i:j], words)) for i, j in zip(off[:-1].tolist(), off[1:].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(fp, dtype=">i8").astype(np.int64))], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


def _ball(value: Column, bits: int) -> Column:
    """The value and all that differ from it in one of its low bits."""
    return F.array(value, *(value.bitwiseXOR(F.lit(1 << i)) for i in range(bits)))


def near_pairs(classes: DataFrame, most: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of fingerprints (fp, all different) at distance 1..2, from the tables of both halves."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    entry = lambda seg, key, home: F.struct(F.lit(seg).alias("seg"), key.alias("key"), F.lit(home).alias("home"))
    own = F.array(entry(0, high, True), entry(1, low, True))
    around = F.transform(F.slice(_ball(high, 32), 2, 32), lambda k: entry(0, k, False))
    rows = classes.select("fp", F.explode(F.when(F.bit_count(high) % 2 == 0, F.concat(own, around)).otherwise(own)).alias("e")).select("e.*", "fp")
    rows = materialise(rows)
    full = materialise(rows.where("home").groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).drop("n"))
    at = ["seg", "key", "fine"]

    def met(some: DataFrame) -> DataFrame:
        left = some.select(*at, F.col("fp").alias("x"), F.col("home").alias("visit_home"))
        right = some.where("home").select(*at, F.col("fp").alias("y"))
        pairs = left.join(right, at).where("x < y OR NOT visit_home AND x > y")
        return pairs.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    whole = F.lit(-1).cast("long")
    if full.isEmpty():
        return met(rows.withColumn("fine", whole)).distinct()
    # In a full entry members meet by a neighbour of their other half.
    other = F.when(F.col("seg") == 0, low).otherwise(high)
    fine = rows.join(full, ["seg", "key"], "left_semi").select("seg", "key", "home", "fp", F.explode(_ball(other, 32)).alias("fine"))
    few = rows.join(full, ["seg", "key"], "left_anti").withColumn("fine", whole)
    return met(few).unionByName(met(fine)).distinct()


def link_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: 3-word shingles, 64 bits, links at 2 bits or fewer.

    Components are those of fingerprints; ids come in last, as the smallest of each component.
    """
    rows = materialise(fingerprints(docs, 3))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(near_pairs(classes, crowd=crowd)).join(classes.withColumnRenamed("fp", "node"), "node")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = linked.join(lows, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    named = classes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicate groups by fingerprints and word shingles -----------------------------------

#: Shared shingles come last in the order of prefixes: those in COMMON or more of one text in SAMPLE,
#: MOST_COMMON of them. The order decides how many candidates there are, never which pairs are found.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 1 << 14
#: Members of a shingle up to which all are compared with each other at once.
SMALL = 64
#: Parts that a common shingle's rows are dealt to.
SALTS = 1 << 12
#: Bytes of shingle sets that are brought to pairs at once, about: the PORTION-th part of the texts' bytes, but so many at least.
SETS_BYTES, PORTION = 1 << 29, 4


def _pack_rows(columns, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes (64 bits) of each text's shingles; a shorter text is one shingle."""
    for _, _, data, off in chunks(column):
        c = Chunk(data, off, lower=True)
        h = c.words()
        grams, at = c.word_grams(h, words)
        bounds = np.searchsorted(at, c.word_off)
        for i in range(c.n):
            n = c.n_words[i]
            if n >= words:
                yield np.unique(grams[bounds[i] : bounds[i + 1]])
            else:
                short = xxhash.xxh64_intdigest(h[c.word_off[i] : c.word_off[i + 1]].tobytes(), SEED)
                yield np.full(min(n, 1), short, dtype=np.uint64)


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (in order) and counts of the most frequent shingles in a sample of the texts."""

    def run(batches):
        others_go()
        for batch in batches:
            for h in _sets(batch.column("text"), words):
                for i in range(0, len(h), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + BLOCK].view(np.int64))], ["key"])

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "key long")
    top = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON)
    with swept(rows.sparkSession):
        top = top.collect()
    hashes = np.array([r.key for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in top], dtype=np.int64)[order]


PREFIX = "key long, salt int, id long, at int, size int"
PREFIX_KINDS, PREFIX_NAMES = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), [x.split()[0] for x in PREFIX.split(", ")]


def prefix_rows(rows: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, salt, id, at, size): the first shingles of each text in one order of all shingles.

    A text of n distinct shingles shares at least similarity * n of them with any text alike, so of
    two texts alike the first n - similarity * n + 1 (rounded up) have a shingle in common. Common
    shingles have a salt above 0, by which their rows are spread.
    """
    hashes, counts = common

    def run(batches):
        others_go()
        for batch in batches:
            out, held = [], 0
            for k, h in zip(batch.column("id").to_pylist(), _sets(batch.column("text"), words)):
                n = len(h)
                if not n:
                    continue
                times = np.zeros(n, np.int64)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    times = np.where(hashes[place] == h, counts[place], 0)
                    order = np.argsort(times, kind="stable")
                    h, times = h[order], times[order]
                m = n - int(np.ceil(similarity * n - 1e-9)) + 1
                out.append((h[:m].view(np.int64), np.where(times[:m] > 0, 1 + k % SALTS, 0), np.full(m, k, np.int64), np.arange(m, dtype=np.int32), np.full(m, n, np.int32)))
                held += m
                if held >= BLOCK:
                    yield _pack_rows([np.concatenate(c) for c in zip(*out)], PREFIX_KINDS, PREFIX_NAMES)
                    out, held = [], 0
            if out:
                yield _pack_rows([np.concatenate(c) for c in zip(*out)], PREFIX_KINDS, PREFIX_NAMES)

    return rows.select("id", "text").mapInArrow(run, PREFIX)


def shared_rows(first: DataFrame, small: int) -> DataFrame:
    """(key, id, at, size, many) of prefix rows whose key another row has, by one shuffle: in the order
    of the keys a row without an equal beside it goes. many: the key has more than `small` rows, or
    is common (of those all rows stay). At most `small` rows are held for the next batch."""
    names, kinds = ["key", "id", "at", "size", "many"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def run(batches):
        held, crowd = None, None  # rows of a run that may go on; the key of a larger one that may
        for batch in batches:
            table = [np.asarray(batch.column(c)) for c in PREFIX_NAMES]
            if held is not None:
                table = [np.concatenate(x) for x in zip(held, table)]
            key, salt = table[0], table[1]
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            many = (size > small) | (salt[begin] > 0)
            many[0] |= crowd is not None and key[0] == crowd
            end = len(key) if many[-1] else begin[-1]
            held, crowd = [a[end:] for a in table], key[-1] if many[-1] else None
            stay = np.repeat(many | (size > 1), size)[:end]
            if stay.any():
                yield _pack_rows([table[c][:end][stay] for c in (0, 2, 3, 4)] + [np.repeat(many, size)[:end][stay]], kinds, names)
        if held is not None and len(held[0]) > 1:
            yield _pack_rows([held[c] for c in (0, 2, 3, 4)] + [np.zeros(len(held[0]), bool)], kinds, names)

    return first.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, "key long, id long, at int, size int, many boolean")


def shingle_sets(rows: DataFrame, words: int, wanted: IdFilter) -> DataFrame:
    """(id, shingles): the sorted distinct hashes of each text's shingles, 32 bits of them. Rows that are not wanted
    are left out where they lie, but for the few that the filter lets pass: texts are not shuffled."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column("place").to_numpy())))
            sets = [np.unique(h.astype(np.uint32)).view(np.int32) for h in _sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int32()))], ["id", "shingles"])

    return rows.select("id", wanted.place().alias("place"), "text").mapInArrow(run, "id long, shingles array<int>")


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """(id, sketch): how many of each text's shingles fall into each range of hashes, about two in a range."""

    def run(batches):
        for batch in batches:
            out = []
            for h in _sets(batch.column("text"), words):
                bits = max(6, int(len(h) / 2 - 1).bit_length()) if len(h) > 2 else 6
                count = np.bincount((h >> np.uint64(64 - min(bits, 16))).astype(np.int64), minlength=1 << min(bits, 16))
                out.append(count.astype(np.uint8).tobytes() if count.max() < 256 else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "sketch"])

    return rows.select("id", "text").mapInArrow(run, "id long, sketch binary")


def may_be_alike(a: bytes | None, b: bytes | None, similarity: float) -> bool:
    """Whether two sketches leave room for the similarity: in a range texts share at most the smaller count."""
    if a is None or b is None:
        return True
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in (a, b))
    n = min(len(x), len(y))
    both = np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum()
    return bool(both * (1 + similarity) + 1e-9 >= similarity * (x.sum() + y.sum()))


def with_room(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches do not exclude them. marks: (id, sketch)."""

    def run(batches):
        for batch in batches:
            keep = [may_be_alike(x, y, similarity) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = marks.select(F.col("id").alias("a"), F.col("sketch").alias("x")), marks.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(x, y, similarity: float):
    """Whether two sets' Jaccard similarity n / (x + y - n) reaches a value; two empty ones are not alike."""
    both = F.size(x) + F.size(y)
    return (both > 0) & (F.size(F.array_intersect(x, y)) * (1 + similarity) + 1e-9 >= similarity * both)


def _fits(similarity: float):
    """Whether rows x and y of one key can be alike if the key is the first that they share: at most the rest of both follows."""
    m, n = F.col("x.size"), F.col("y.size")
    rest = F.least(m - F.col("x.at"), n - F.col("y.at"))
    return (F.least(m, n) + 1e-9 >= similarity * F.greatest(m, n)) & (rest * (1 + similarity) + 1e-9 >= similarity * (m + n))


def portions(rows: DataFrame, size: int) -> int:
    """In how many parts so many bytes of sets are brought to their pairs. Pairs and rows of shared shingles grow faster than
    the texts, so what they take on disk at once is held to a share of the texts."""
    if size <= SETS_BYTES:
        return 1
    texts = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-size // max(SETS_BYTES, texts // PORTION))


def dealt(some: DataFrame, by: list[str], parts: int) -> list[DataFrame]:
    """The rows in so many tables, rows of equal values in one."""
    return [some.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [some]


def alike_pairs(rows: DataFrame, pairs: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the written pairs (a, b) whose similarity reaches the value."""
    sets = scratch.keep(shingle_sets(rows, words, IdFilter(_ends(pairs))), "sets")
    sa, sb = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    mean = sets.agg(F.avg(F.size("shingles"))).first()[0] or 0
    links = []
    for some in dealt(pairs, ["a", "b"], portions(rows, int(4 * mean * pairs.count()))):
        links.append(scratch.keep(some.join(sa, "a").join(sb, "b").where(_alike(F.col("sa"), F.col("sb"), similarity)).select("a", "b"), "links"))
    scratch.drop("sets")
    return reduce(DataFrame.unionByName, links)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def print_pairs(rows: DataFrame, words: int, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(a, b): ids that SimHash takes for near copies. Fingerprints link as in `link_groups`; each row is paired with the
    least id of its fingerprint, and these with each other where fingerprints link."""
    prints = scratch.keep(fingerprints(rows.select(F.col("id").alias("doc_id"), "text"), words).withColumnRenamed("doc_id", "id"), "prints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    own = prints.join(classes.where("n > 1"), "fp").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    ends = [classes.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low")) for c in ("a", "b")]
    linked = near_pairs(classes.select("fp"), crowd=crowd).join(ends[0], "a").join(ends[1], "b")
    linked = linked.select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b"))
    pairs = scratch.keep(own.unionByName(linked), "alike_prints")
    scratch.drop("prints", "classes")
    return pairs


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one group already. roots: (node, root)."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own in the column `name`: the id where ids are unique, else one
    that is written with the rows to the shared folder."""
    spark, key = docs.sparkSession, F.col("doc_id").cast("long")
    twice = bounded(docs).select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL")
    if twice.isEmpty():
        return docs.withColumn(name, key)
    path = fresh_path(spark, "numbered")
    docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def near_links(rows: DataFrame, words: int = 5, similarity: float = 0.8, small: int = SMALL) -> DataFrame:
    """(node, root) of rows (id, text) that have a near copy: root is the smallest id of the group.

    Two rows are linked if the Jaccard similarity of their sets of `words`-word shingles reaches
    `similarity`; groups are connected components. A text of fewer words is one shingle, a text
    without words is linked to nothing. Shingles are compared by hashes: 64 bits in the search, 32 bits
    in the verified sets, where two shingles of a pair of 500-shingle texts are taken for one about
    once in 10,000 pairs (a change of the similarity by less than 1/500).

    First come the pairs that SimHash finds, fingerprints of 64 bits that differ in two or fewer; those whose
    similarity bears it out make groups. Copies that differ by more, of which a fingerprint says too little (a
    block of a fifth of a text is 13 to 16 % of its bits), are found by an exact search, which leaves
    out pairs within one of these groups.

    Its candidates are complete: two texts alike have a shingle in common among their first ones
    (prefix_rows), and the first such shingle is compared. Most shingles belong to one text and go; pairs
    whose sketches exclude the similarity go before any text is read;
    the members of one with up to `small` are all compared. In larger ones each member is first compared
    with two only, drawn by hash; what that links makes components. Then the members outside the
    shingle's most frequent component are compared with all others (once, at the first large
    shingle that they share, and inside the join, so only links become rows): pairs inside one component add
    nothing, so no link between groups is lost, and a family of n near copies that belong together
    costs about n comparisons, not n * n. Sets are brought to pairs and to the rows of large shingles part by part
    (portions), so that disk is bounded by the texts; the rows of one shingle stay in one part.
    """
    scratch = Scratch(rows.sparkSession)
    found = alike_pairs(rows, print_pairs(rows, words, scratch), words, similarity, scratch)
    roots = scratch.keep(components(found), "roots")
    scratch.drop("alike_prints")
    met = scratch.keep(shared_rows(prefix_rows(rows, words, similarity, common_shingles(rows, words)), small), "met")
    few = met.where("NOT many")
    ends = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _fits(similarity))
    ends = ends.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    many = met.where("many").drop("many")
    order = F.xxhash64("id", "key")
    tables = many.groupBy("key").agg(F.min_by("id", order).alias("x"), F.max_by("id", order).alias("y")).where("x <> y")
    drawn = many.join(tables, "key").select("key", "id", F.explode(F.array("x", "y")).alias("b")).where("id <> b")
    # Of the drawn ones of a member some are enough: links of the others are found below.
    one = drawn.groupBy("id", F.pmod("key", F.lit(4)).alias("part")).agg(F.min_by("b", F.xxhash64("id", "b")).alias("b1"), F.max_by("b", F.xxhash64("id", "b")).alias("b2"))
    ends = ends.unionByName(one.select(F.col("id").alias("a"), F.explode(F.array("b1", "b2")).alias("b")))
    near = apart(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), roots)
    near = scratch.keep(near, "near")
    near = scratch.keep(with_room(near, scratch.keep(sketches(rows, words), "sketches"), similarity), "room")
    many = scratch.keep(many.join(tables.select("key"), "key", "left_semi"), "many")
    scratch.drop("met", "near", "sketches")
    links = alike_pairs(rows, near, words, similarity, scratch).unionByName(found)

    comp = components(links)
    many = many.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    often = many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    many = scratch.keep(many.join(often.where("roots > 1").drop("roots"), "key"), "apart")
    size = many.agg(F.sum("size")).first()[0]
    if size is None:
        scratch.drop()
        return comp
    sets = scratch.keep(shingle_sets(rows, words, IdFilter(many.select("id").distinct())), "sets")
    keys = many.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", "key")))["key"].alias("keys"))
    c = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (kx, ky), (rx, ry) = c("key"), c("root")
    outside = F.col("x.out") & (~F.col("y.out") | (F.col("x.id") < F.col("y.id")))
    first_met = F.element_at(F.array_intersect(*c("keys")), 1) == kx
    more = []
    # A row takes 4 bytes a shingle, and 8 for each of its keys, which are a fifth of the shingles at most.
    for some in dealt(many, ["key"], portions(rows, 6 * size)):
        side = scratch.keep(some.join(sets.join(keys, "id"), "id").withColumn("out", F.col("root") != F.col("main")), "side")
        x, y = side.alias("x"), side.alias("y")
        # The whole test is the join's condition: pairs that fail it are never rows.
        met = x.join(y, (kx == ky) & outside & (rx != ry) & _fits(similarity) & first_met & _alike(*c("shingles"), similarity))
        more.append(scratch.keep(met.select(F.least(*c("id")).alias("a"), F.greatest(*c("id")).alias("b")).distinct(), "more"))
        scratch.drop("side")
    comp = components(reduce(DataFrame.unionByName, more, links))
    scratch.drop()
    return comp


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, small: int = SMALL) -> DataFrame:
    """(doc_id, group_id), one row for each row that has a near copy: group_id is the group's smallest id.

    Rows are compared by themselves, whatever their ids: rows of null id and rows that share an id
    take part like all others, repeated rows are near copies of each other, and group_id is null
    only if all ids of the group are. Rows that have none, and texts without words, are left out.
    """
    own = spare(docs, "row")
    rows = numbered(docs, own).select(F.col(own).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), _text())
    groups = near_links(rows, words, similarity, small).join(rows.select(F.col("id").alias("node"), "doc_id"), "node")
    return groups.join(groups.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("doc_id", "group_id")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, small: int = SMALL) -> DataFrame:
    """The rows, with all their columns, that stay: of each group of near copies the one of smallest id
    (null last; of equal ids one row), and all rows without near copies."""
    own = spare(docs, "row")
    rows = numbered(docs, own)
    texts = rows.select(F.col(own).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), _text())
    groups = near_links(texts, words, similarity, small).join(texts.select(F.col("id").alias("node"), "doc_id"), "node")
    stays = groups.groupBy("root").agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("stays"))
    lost = Scratch(docs.sparkSession).keep(groups.join(stays, "root").where("node <> stays").select(F.col("node").alias(own)), "lost")
    return rows.join(lost, own, "left_anti").select(*docs.columns)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
