"""Repeated-substring removal: every byte covered by a `length`-byte string that starts anywhere else.

Equal strings of `length` bytes pick the same anchor: the position in them whose GRAM-byte string
has the smallest hash (leftmost of equals). So two equal strings meet at anchors of equal GRAM-byte
strings, and only anchors are shuffled, one per about half a window of text.

1. Anchors whose GRAM-byte string is found once anywhere can cover nothing and go (aggregated by
   key, joined back by Spark's skew-aware join).
2. Anchors of equal surroundings (all the bytes that a string through the anchor can reach, told by
   160 bits of hashes with two bases) are one class. If a class has two members all its surroundings
   are repeated. That settles copies of any number without comparing them.
3. What is left are classes that share the GRAM-byte string but not all surroundings. Their suffixes
   from the anchor, and their reversed prefixes before it, are put in order by a merge sort that
   compares two of them in logarithmic time: prefix polynomial hashes and a binary search give the
   common extension, the next byte decides. The orders and the common extensions of neighbours are
   verified byte by byte; where a hash collided the batch is sorted by bytes. In these orders the
   classes that agree on o bytes before the anchor and length - o from it are runs, so for each o
   the repeated strings follow, and from the smallest and largest o the bytes covered.
4. A GRAM-byte string with more than HEAVY classes is not brought into one task. The places a string
   can have around the anchor are cut into PARTS ranges; what all strings of a range share (23/24 of
   their length) is a finer key, by 128 bits of hash, and the few bytes on both sides of it are
   compared as in 3. Finer keys with more than HUGE rows are settled by counting those bytes
   with partial aggregation.

All strings are judged on the input. Documents are never crossed. A text is known by 128 bits of
hashes, not by its row's id: what is repeated in a text is so in all its copies, so the spans of
equal texts are gathered once, and rows are joined to them.

Defined results: null text is empty; a text shorter than `length` loses nothing; repeated rows are
occurrences like any other, so their text is removed in all of them; ids may be null or shared; extra
columns of any name are kept by `without_repeats` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, bounded, spare
from .kept import others_go
from .nptext import BASE, INVERSE, WHITE, buffers, chunks, mix, powers, prefix_hash

LENGTH = 400
#: Classes of one GRAM-byte string that are compared in one task, at most.
HEAVY = 4096
#: Classes sorted at once.
BATCH = 4096
#: Ranges that the places around the anchor of a heavy string are cut into, and classes of one range
#: that are compared in one task, at most.
PARTS, HUGE = 16, 1 << 16
BASE2 = 0xC2B2AE3D27D4EB4F
INVERSE2 = pow(BASE2, -1, 1 << 64)
U = np.uint64


def gram_size(length: int) -> int:
    return max(1, length * 8 // 25)


# --- anchors ------------------------------------------------------------------------------------


def window_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w elements, from running minima of blocks of w in both directions."""
    n = len(key)
    if n < w:
        return key[:0]
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = key
    block = full.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a chunk's anchors: document, position in it, hash of the gram, of the surroundings, and 32 more bits of the latter."""
    gram = gram_size(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    prefix = prefix_hash(data)
    m = len(data) - gram + 1
    h = mix((prefix[gram:] - prefix[:m]) * powers(INVERSE, m))
    low = window_min((h & U(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64), length - gram + 1)
    starts = np.zeros(len(data) + 1, dtype=np.int32)
    long_ = np.flatnonzero(np.diff(off) >= length)
    starts[off[long_]] += 1
    starts[off[long_ + 1] - length + 1] -= 1
    at = (low[np.cumsum(starts[: len(low)]) > 0] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none, none, none
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    doc = np.searchsorted(off, at, side="right") - 1
    lo, hi = np.maximum(off[doc], at - (length - gram)), np.minimum(off[doc + 1], at + length)
    p2 = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(BASE2, len(data)), out=p2[1:])
    around = (p2[hi] - p2[lo]) * powers(INVERSE2, len(p2))[lo]
    around = mix(around + (at - lo).astype(np.uint64) * U(0xA0761D6478BD642F) + (hi - at).astype(np.uint64) * U(0xE7037ED1A0B428DB))
    check = mix((prefix[hi] - prefix[lo]) * powers(INVERSE, len(prefix))[lo]) >> U(32)
    return doc, at - off[doc], h[at].view(np.int64), around.view(np.int64), check


#: What identifies a text: two 64-bit hashes with seeds of their own.
TEXT_KEY = ["k1", "k2"]


def keys_of(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, text) of every row: equal texts have one key, since what is repeated in one is in all."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = keys_of(text)
    return bounded(docs).select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(gram, around, check, k1, k2, at): every anchor of every row."""
    names = ["gram", "around", "check", "k1", "k2", "at"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def run(batches):
        others_go()
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(c)) for c in TEXT_KEY)
            for i, j, data, off in chunks(batch.column("text")):
                doc, at, gram, around, check = anchors(data, off, length)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((gram, around, check.astype(np.int64), k1[i + doc], k2[i + doc], at), kinds)], names)

    return rows.mapInArrow(run, "gram long, around long, check long, k1 long, k2 long, at int")


# --- order of suffixes --------------------------------------------------------------------------


class Strings:
    """Byte strings in one array, with prefix hashes for their common extensions."""

    def __init__(self, items: list[bytes]):
        self.n = len(items)
        self.size = np.fromiter(map(len, items), dtype=np.int64, count=self.n)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join(items) + b"\0", dtype=np.uint8)
        self.prefix = prefix_hash(self.data)
        self.inverse = powers(INVERSE, len(self.prefix))
        self.most = int(self.size.max()) if self.n else 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of strings a and b: binary search over equal prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        sa, sb = self.at[a], self.at[b]
        ia, ib, pa_, pb = self.inverse[sa], self.inverse[sb], self.prefix[sa], self.prefix[sb]
        for _ in range(self.most.bit_length() + 1):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[sa + mid] - pa_) * ia == (self.prefix[sb + mid] - pb) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether a < b (or a <= b)."""
        k = self.common(a, b)
        end_a, end_b = k >= self.size[a], k >= self.size[b]
        less = self.data[np.minimum(self.at[a] + k, len(self.data) - 1)] < self.data[np.minimum(self.at[b] + k, len(self.data) - 1)]
        return np.where(end_a & end_b, or_equal, np.where(end_a, True, np.where(end_b, False, less)))


def merge_sort(s: Strings, group_at: np.ndarray) -> np.ndarray:
    """Order of the strings within groups (group_at: the n+1 bounds), by rounds of merges.

    In a round all runs of all groups merge at once: each string's rank in the run beside its own
    is found by binary search.
    """
    order = np.arange(s.n)
    size = np.diff(group_at)
    first, last = np.repeat(group_at[:-1], size), np.repeat(group_at[1:], size)
    width, most = 1, int(size.max()) if len(size) else 0
    place = np.arange(s.n) - first
    while width < most:
        run = place // width
        left = run % 2 == 0
        lo = np.minimum(first + (run + np.where(left, 1, -1)) * width, last)
        hi = np.minimum(lo + width, last)
        busy = np.flatnonzero((lo < hi) & (lo >= first))
        own = first + run * width
        a, b = lo[busy].copy(), hi[busy].copy()
        me, is_left = order[busy], left[busy]
        for _ in range(width.bit_length()):
            live = a < b
            mid = np.where(live, (a + b) >> 1, lo[busy])
            # Of equals those of the left run come first.
            other = order[mid]
            up = np.where(is_left, s.before(other, me, False), s.before(other, me, True)) & live
            a, b = np.where(up, mid + 1, a), np.where(live & ~up, mid, b)
        rank = a - lo[busy]
        target = np.arange(s.n)
        target[busy] = np.minimum(own[busy], lo[busy]) + (busy - own[busy]) + rank
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def ordered(items: list[bytes], group_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order within groups and the common extension of each string with the one before it (-1 for
    the first of a group), verified byte by byte."""
    s = Strings(items)
    for attempt in range(2):
        if attempt:
            order = np.concatenate([np.array(sorted(range(a, b), key=items.__getitem__), dtype=np.int64) for a, b in zip(group_at[:-1], group_at[1:])])
        else:
            order = merge_sort(s, group_at)
        table = np.zeros((s.n, s.most + 1), dtype=np.int16)
        inside = np.arange(s.most + 1) < s.size[:, None]
        table[inside] = s.data[:-1].astype(np.int16) + 1
        x, y = table[order[:-1]], table[order[1:]]
        differ = x != y
        exact = np.where(differ.any(axis=1), differ.argmax(axis=1), s.size[order[:-1]])
        k = np.arange(s.n - 1)
        inner = np.ones(s.n - 1, dtype=bool)
        inner[group_at[1:-1] - 1] = False
        in_order = x[k, np.minimum(exact, s.most)] <= y[k, np.minimum(exact, s.most)]
        if (in_order | ~inner).all():
            break
    return order, np.concatenate([[-1], np.where(inner, exact, -1)]) if s.n else np.zeros(0, np.int64)


def covered(befores: list[bytes], afters: list[bytes], group_at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class the bytes covered before and after its anchor (-1: none).

    befores: the reversed bytes before the anchor; afters: the bytes from it. Two classes share a
    string of `length` bytes, o of them before the anchor, if they agree on o bytes before and
    length - o after it; o is length - gram at most.
    """
    n = len(afters)
    reach_b, reach_a = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    order_a, lcp_a = ordered(afters, group_at)
    order_b, lcp_b = ordered(befores, group_at)
    rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - gram + 1):
        run_a, run_b = np.cumsum(lcp_a < length - o) - 1, np.cumsum(lcp_b < o) - 1
        rid[order_a], lid[order_b] = run_a, run_b
        some = np.flatnonzero((np.bincount(run_a)[rid] > 1) & (np.bincount(run_b)[lid] > 1))
        if len(some) < 2:
            continue
        key = lid[some] * n + rid[some]
        at = np.argsort(key, kind="stable")
        k = key[at]
        same = k[1:] == k[:-1]
        hit = some[at[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        # A run of one class whose string is shorter than o or length - o has no partner, so hits have the bytes.
        reach_b[hit] = o
        fresh = hit[reach_a[hit] < 0]
        reach_a[fresh] = length - o
    return reach_b, reach_a


# --- the operator -------------------------------------------------------------------------------


def ranges(length: int) -> tuple[int, list[int]]:
    """PARTS ranges over 0..length - gram: their common width and where they begin."""
    n = length - gram_size(length) + 1
    width = -(-n // PARTS)
    return width, sorted({min(r * width, n - width) for r in range(PARTS)})


AROUND = "gram long, around long, check long, sub1 long, sub2 long, o long, before binary, after binary"


def _surroundings(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """For the wanted anchors (k1, k2, [(gram, around, check, at, heavy)]): the bytes around them; of heavy ones, for each range of places that a string can have around the anchor, the hashes of
    what all those strings share and the few bytes on both sides that tell them apart."""
    gram = gram_size(length)
    width, firsts = ranges(length)
    names = [x.split()[0] for x in AROUND.split(", ")]
    kinds = (pa.int64(),) * 6 + (pa.binary(),) * 2

    def span(text: np.ndarray, base: int, inverse: int) -> np.ndarray:
        p = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + U(1)) * powers(base, len(text)), out=p[1:])
        return lambda a, b: (p[b] - p[a]) * powers(inverse, len(p))[a]

    def run(batches):
        seen = set()  # of equal texts one is enough
        for batch in batches:
            out: list[tuple] = []
            data, off = buffers(batch.column("text"))
            wants, key = batch.column("wanted"), list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            for i, j, k in zip(off[:-1].tolist(), off[1:].tolist(), range(batch.num_rows)):
                if key[k] in seen:
                    continue
                seen.add(key[k])
                text = data[i:j]
                for w in wants[k].as_py():
                    at = w["at"]
                    if not w["heavy"]:
                        out.append((w["gram"], w["around"], w["check"], None, None, None, text[max(0, at - length + gram) : at][::-1].tobytes(), text[at : at + length].tobytes()))
                    else:
                        lo = max(0, at - length + gram)
                        part, here = text[lo : at + length], at - lo
                        o = np.array([x for x in firsts if x <= here and here + length - x - width + 1 <= len(part)], dtype=np.int64)
                        if len(o):
                            a, b = here - o, here + length - o - width + 1
                            salt = mix(o.astype(np.uint64) + U(w["gram"] & (2**64 - 1)))
                            h1, h2 = (mix(span(part, *k)(a, b) + salt).view(np.int64).tolist() for k in ((BASE, INVERSE), (BASE2, INVERSE2)))
                            out += [(w["gram"], w["around"], w["check"], x, y, z, part[max(0, p - width + 1) : p][::-1].tobytes(), part[q : q + width - 1].tobytes()) for x, y, z, p, q in zip(h1, h2, o.tolist(), a.tolist(), b.tolist())]
                while len(out) > 4000:
                    yield batch_of(out[:4000])
                    del out[:4000]
            if out:
                yield batch_of(out)

    def batch_of(some):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return rows.join(wanted, TEXT_KEY).select("k1", "k2", "text", "wanted").mapInArrow(run, AROUND)


def _compare(strings: DataFrame, keys: list[str], length: int, gram: int) -> DataFrame:
    """Adds back and ahead to the rows that share a string with another row of equal keys."""
    names = [c for c in strings.columns if c not in ("before", "after")]

    def solve(held: dict[str, list], n: int):
        column = [np.array(held[k][:n], dtype=np.int64) for k in keys]
        fresh = np.zeros(n, dtype=bool)
        for c in column:
            fresh[1:] |= c[1:] != c[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(fresh), [n]])
        back, ahead = covered(held["before"][:n], held["after"][:n], bounds, length, gram)
        hit = np.flatnonzero(back >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.array(held[c][:n], np.int64)[hit]) for c in names] + [pa.array(back[hit]), pa.array(ahead[hit])], [*names, "back", "ahead"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in (*names, "before", "after")}
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                for c, own in held.items():
                    own.extend(batch.column(c)[i : i + BATCH].to_pylist())
                n = len(held["before"])
                if n >= BATCH:
                    last = [held[k][-1] for k in keys]
                    while n and [held[k][n - 1] for k in keys] == last:
                        n -= 1
                    if n:
                        yield solve(held, n)
                        held = {c: own[n:] for c, own in held.items()}
        if held["before"]:
            yield solve(held, len(held["before"]))

    schema = ", ".join(f"{c} long" for c in (*names, "back", "ahead"))
    return strings.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _count(strings: DataFrame, keys: list[str], width: int) -> DataFrame:
    """What _compare finds in margins (length width - 1, gram 0), by counting with partial aggregation."""
    k = F.col("k")
    one = strings.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    one = one.where((F.octet_length("before") >= k) & (F.octet_length("after") >= width - 1 - k))
    one = one.withColumn("x", F.substring("before", F.lit(1), k)).withColumn("y", F.substring("after", F.lit(1), F.lit(width - 1) - k)).drop("before", "after")
    twice = one.groupBy(*keys, "k", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    names = [c for c in strings.columns if c not in ("before", "after")]
    return one.join(twice, [*keys, "k", "x", "y"]).groupBy(*names).agg(F.max("k").cast("long").alias("back"), (F.lit(width - 1) - F.min("k")).cast("long").alias("ahead"))


def repeated(rows: DataFrame, length: int = LENGTH, heavy: int = HEAVY, huge: int = HUGE) -> DataFrame:
    """(k1, k2, hits): for each text with repeats, the spans covered around its anchors.

    rows: as `keyed` makes them. Intermediate tables are written to the shared folder.
    """
    scratch, gram = Scratch(rows.sparkSession), gram_size(length)
    found = anchor_rows(rows, length)
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"), F.min("check").alias("low"), F.max("check").alias("high")).where("n > 1")
    # Written first, so that Spark's skew join can split what meets it.
    often = scratch.keep(often.select("gram", ((F.col("lo") != F.col("hi")) | (F.col("low") != F.col("high"))).alias("mixed")), "often")
    again = scratch.keep(found.join(often, "gram"), "anchors")

    one = ["gram", "around", "check"]
    classes = again.where("mixed").groupBy(*one).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in (*TEXT_KEY, "at")))
    classes = scratch.keep(classes, "classes")
    groups = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("single")).where("m > 1 AND single > 0")
    wanted = classes.join(scratch.keep(groups, "groups"), "gram").select(*TEXT_KEY, F.struct(*one, "at", (F.col("m") > heavy).alias("heavy")).alias("w"))
    wanted = wanted.groupBy(*TEXT_KEY).agg(F.collect_list("w").alias("wanted"))
    around = scratch.keep(_surroundings(rows, wanted, length), "around")

    light = _compare(around.where("sub1 IS NULL").select(*one, "before", "after"), ["gram"], length, gram)
    width = ranges(length)[0]
    key = ["sub1", "sub2"]
    margins = around.where("sub1 IS NOT NULL")
    large = margins.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > huge).drop("m")
    parts = _compare(margins.join(large, key, "left_anti"), key, width - 1, 0).unionByName(_count(margins.join(large, key), key, width))
    # Places in a range are counted from its first; ranges of one class are put together.
    parts = parts.groupBy(*one).agg(F.max(F.col("o") + F.col("back")).alias("back"), F.max(F.lit(length - width + 1) - F.col("o") + F.col("ahead")).alias("ahead"))
    partly = light.unionByName(parts)
    reach = (F.lit(length - gram).cast("long").alias("back"), F.lit(length).cast("long").alias("ahead"))
    whole = classes.where("n > 1").select(*one, *reach)
    settled = whole.unionByName(partly.join(whole.select(*one), one, "left_anti"))
    found = [*TEXT_KEY, "at", "back", "ahead"]
    hits = again.where("NOT mixed").select(*TEXT_KEY, "at", *reach).unionByName(again.where("mixed").join(settled, one).select(*found))
    span = F.struct((F.col("at") - F.col("back")).alias("lo"), (F.col("at") + F.col("ahead")).alias("hi"))
    hits = scratch.keep(hits.groupBy(*TEXT_KEY).agg(F.collect_set(span).alias("hits")), "hits")
    last = scratch.paths.pop()
    scratch.drop()
    scratch.paths.append(last)
    return hits


def spans(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of [lo, hi) within 0..n, in order."""
    if not len(lo):
        return lo, hi
    lo, hi = np.maximum(lo, 0), np.minimum(hi, n)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[first], hi[np.concatenate([first[1:], [True]])]


def row_spans(batch: pa.RecordBatch, column: str = "hits") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends of the repeated runs) of each row with its hits."""
    data, off = buffers(batch.column("text"))
    hits = batch.column(column)
    none = np.zeros(0, np.int64)
    for k, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        own = hits[k].values
        if own is None:
            yield data[i:j], none, none
        else:
            yield data[i:j], *spans(own.field("lo").to_numpy(), own.field("hi").to_numpy(), j - i)


def kept_bytes(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return b"".join(text[a:b].tobytes() for a, b in zip(np.concatenate([[0], hi]).tolist(), np.concatenate([lo, [len(text)]]).tolist()))


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            n, removed, runs, sha = [], [], [], []
            for text, lo, hi in row_spans(batch):
                n.append(len(text))
                removed.append(int((hi - lo).sum()))
                runs.append(len(lo))
                sha.append(hashlib.sha256(kept_bytes(text, lo, hi)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    hits = repeated(keyed(docs), length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(dict(zip(TEXT_KEY, keys_of(F.col("text")))))
    joined = rows.join(hits, TEXT_KEY, "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def words_in(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many whole words of the text each of the spans holds."""
    black = np.concatenate([[False], ~WHITE[text], [False]])
    starts, ends = np.flatnonzero(black[1:-1] & ~black[:-2]), np.flatnonzero(black[1:-1] & ~black[2:]) + 1
    return np.maximum(np.searchsorted(ends, hi, side="right") - np.searchsorted(starts, lo, side="left"), 0)


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The same rows and columns with the repeated bytes of `text` removed, every occurrence of them.

    Of the repeated runs those that hold more than `words` whole words go, and a run that would cut a character
    is narrowed to whole characters. A row whose whole text is repeated stays, with an empty text.
    Where a column n_chars is there it gives the new length.
    """
    k1, k2, found = spare(docs, "k1"), spare(docs, "k2"), spare(docs, "hits")

    def run(batches):
        for batch in batches:
            out = []
            for text, lo, hi in row_spans(batch, found):
                lo, hi = lo.copy(), hi.copy()
                if words and len(lo):
                    long_ = words_in(text, lo, hi) > words
                    lo, hi = lo[long_], hi[long_]
                for k in range(len(lo)):
                    while lo[k] < hi[k] and lo[k] < len(text) and text[lo[k]] & 0xC0 == 0x80:
                        lo[k] += 1
                    while hi[k] > lo[k] and hi[k] < len(text) and text[hi[k]] & 0xC0 == 0x80:
                        hi[k] -= 1
                out.append(kept_bytes(text, lo, hi))
            names = [c for c in batch.schema.names if c != found]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in out], pa.string()) if c == "text" else batch.column(c) for c in names], names)

    hits = repeated(keyed(docs), length).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("hits").alias(found))
    own = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = own.withColumns(dict(zip((k1, k2), keys_of(F.col("text")))))
    joined = own.join(hits, [k1, k2], "left").select(*docs.columns, found)
    cut = joined.mapInArrow(run, joined.select(*docs.columns).schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
