"""Sequence packing by the online sum-of-squares rule.

Each partition packs its own documents. A level array counts the open windows at every fill. A
document (what is left of it after whole windows are cut off) goes to the fill level, or to a new
window, that makes the sum of the squared counts smallest; of equal choices the fullest window is
taken. The documents of windows still open when the partition ends are carried on: they are written
with their ids, dealt to as many tasks as they need (TASK_TOKENS each), and packed again by the same
rule, round after round, until one task holds all that is left (or a round fills few windows more,
as with texts of which no two fit in a window). Only the last round cuts: the pieces of its open
windows are joined and cut to full windows, and the rest to windows whose fills are powers of two,
so no window needs padding.

A round's table is written before the next one begins, and its order is that of the rows' slots, so
sequence numbers (round, partition, count) do not change when a task is run again.

Defined results: null or empty text is one token (the end id); ids may be null or repeated; an empty
table gives no pieces; a text of any length is cut to whole windows and a rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh_path, text_rows
from .kept import LETTERS, Kept, held, others_go
from .nptext import buffers

WINDOW = 4096
END_ID = 2
#: Tokens of open windows that are packed in one task of a later round, about.
TASK_TOKENS = 1 << 23
#: Pieces whose ids a worker keeps.
KEPT = 700_000


class Packer:
    """Items (key, start, ids) to windows: lists of items whose lengths add up to the window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """The fill level for an item of less than a window; 0 is a new window."""
        n, w = self.level, self.window
        top = w - size
        # Half the change of the sum of squares, less 1/2, times 2: kept whole for exact ties.
        cost = 2 * (n[size : w + 1] - n[: top + 1]) + 1
        cost[top] = -2 * n[top]
        cost[0] = 2 * n[size]
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, key, ids: np.ndarray, start: int = 0) -> Iterator[list]:
        """start: the item's place in its document."""
        w, at = self.window, 0
        while len(ids) - at >= w:
            yield [(key, start + at, ids[at : at + w])]
            at += w
        size = len(ids) - at
        if not size:
            return
        fill = self.choose(size)
        into = self.open[fill].pop() if fill else []
        if fill:
            self.level[fill] -= 1
        into.append((key, start + at, ids[at:].copy()))
        if fill + size == w:
            yield into
        else:
            self.level[fill + size] += 1
            self.open[fill + size].append(into)

    def left(self) -> list:
        """The items of the windows still open."""
        return [item for fill in range(self.window, 0, -1) for into in self.open[fill] for item in into]

    def close(self) -> Iterator[list]:
        """Windows of what is still open: full ones, then powers of two."""
        rest = self.left()
        left = sum(len(i[2]) for i in rest)
        self.__init__(self.window)
        goal, into, room = 0, [], 0
        for key, start, ids in rest:
            at = 0
            while at < len(ids):
                if not room:
                    room = goal = min(self.window, 1 << (left.bit_length() - 1))
                take = min(room, len(ids) - at)
                into.append((key, start + at, ids[at : at + take]))
                at, room, left = at + take, room - take, left - take
                if not room:
                    yield into
                    into = []
        assert not into and goal >= 0


class WordIds:
    """Ids of texts by the tokenizers library.

    This vocabulary drops white space, lower-cases, and cuts between letters and punctuation, so a
    text's ids are those of its pieces between white space one after the other, and a piece's those of
    its words and of what stands between them; each distinct piece is encoded once and kept. ASCII letters are lower-cased first, which the vocabulary would do anyway, but where a
    text may hold the (lower-case) string of a special token.
    """

    PIECE = re.compile(LETTERS + rb"|[^\s]+")
    WORD = re.compile(LETTERS)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # For lower-case words of ASCII or Latin-1 letters neither normalising nor cutting changes anything.
        with open(path, encoding="utf-8") as f:
            spec = json.load(f) | {"normalizer": None, "added_tokens": []}
        split, bytes_ = {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.plain = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, bytes_]}}))
        del spec
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept = Kept(self.learn, KEPT)

    def learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of each piece: those of its words and what stands between them."""
        find, young, old = self.PIECE.findall, self.kept.young, self.kept.old
        parts = {p: find(p) for p in new if not p.isalpha()}
        need = {x for some in parts.values() for x in some if x not in young and x not in old}
        out = self.words(sorted(need.union(p for p in new if p not in parts)))
        ids = lambda x: out.get(x) or young.get(x) or old.get(x) or b""
        return [b"".join(map(ids, parts[p])) if p in parts else out[p] for p in new]

    def words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Words of ASCII or Latin-1 letters are encoded many at a time: each is one pretoken, and its
        last token is one that ends a word."""
        out: dict[bytes, bytes] = {}
        whole = self.WORD.fullmatch
        words = [p for p in new if (p.isalpha() and p.islower() if p.isascii() else whole(p))]
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode().lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) == len(some):
                raw = ids.tobytes()
                out.update(zip(some, [raw[a:b] for a, b in zip([0, *cut], cut)]))
        rest = [p for p in new if p not in out]
        for i in range(0, len(rest), 4096):
            got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest[i : i + 4096]], add_special_tokens=False)
            out.update(zip(rest[i : i + 4096], [np.array(e.ids, dtype="<u4").tobytes() for e in got]))
        return out

    def encode(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        for lo in range(0, len(raws), 64):
            some = [(r if b"<|" in r else r.lower()).split() for r in raws[lo : lo + 64]]
            got = [list(map(self.kept.young.get, s)) for s in some]
            # What is not there is computed for all these texts at once.
            gaps = [list(_nones(g)) for g in got]
            new = {s[i] for s, at in zip(some, gaps) for i in at}
            if new:
                kept = self.kept.of(new)
                for s, g, at in zip(some, got, gaps):
                    for i in at:
                        g[i] = kept[s[i]]
            for g in got:
                yield np.frombuffer(b"".join(g), dtype="<u4")


def _nones(items: list) -> Iterator[int]:
    """Places of None."""
    at = -1
    for _ in range(items.count(None)):
        at = items.index(None, at + 1)
        yield at


def word_ids(path: str) -> WordIds:
    others_go("packing")
    mine = held("packing")
    if path not in mine:
        mine[path] = WordIds(path)
    return mine[path]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("slot", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STORED = PIECES + ", slot long, ids binary"


def _windows(items: Iterator, packer: Packer, number: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the windows that items ((doc_id, tokens), start, ids) fill; of open ones the pieces
    with their ids and a slot instead of a place, or in the last round the windows cut from them."""
    base, made, slots = number << 56 | TaskContext.get().partitionId() << 36, 0, 0
    rows: list[tuple] = []
    size = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    def full():
        for key, ids, start in items:
            yield from packer.add(key, ids, start)
        if last:
            yield from packer.close()

    for window in full():
        at = 0
        for (doc, total), start, ids in window:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + made, at, None, None))
            at += len(ids)
        made += 1
        if len(rows) >= 5000:
            yield batch()
            rows.clear()
    for (doc, total), start, ids in () if last else packer.left():
        raw = ids.tobytes()
        rows.append((doc, start, len(ids), zlib.crc32(raw), total, None, None, base + slots, raw))
        slots, size = slots + 1, size + len(raw)
        if len(rows) >= 5000 or size >= 1 << 22:
            yield batch()
            rows.clear()
            size = 0
    if rows:
        yield batch()


def pack(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID, tokens: int = TASK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession

    def encoded(batches):
        coder, end = word_ids(vocabulary_path), np.array([end_id], dtype="<u4")
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts)):
                ids = np.concatenate([ids, end])
                yield (doc, len(ids)), ids, 0
        coder.kept.rest()

    def carried(batches):
        for batch in batches:
            for doc, total, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids"))):
                yield (doc, total), np.frombuffer(raw, dtype="<u4"), start

    def first(batches):
        return _windows(encoded(batches), Packer(window), 0, False)

    path = fresh_path(spark, "pieces-0")
    text_rows(docs).mapInArrow(first, STORED).write.parquet(path)
    paths, before = [path], None
    while True:
        now = spark.read.schema(STORED).parquet(paths[-1]).where("sequence_id IS NULL")
        left = now.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if not left:
            break
        tasks = -(-left // tokens)
        # Over when one task holds what is left, or when another round would fill few windows more.
        number, last = len(paths), tasks == 1 or before is not None and 4 * left > 3 * before
        path = fresh_path(spark, f"pieces-{number}")

        def again(batches, number=number, last=last):
            return _windows(carried(batches), Packer(window), number, last)

        now.repartition(int(tasks), "slot").sortWithinPartitions("slot").mapInArrow(again, STORED).write.parquet(path)
        paths.append(path)
        before = left
        if last:
            break
    return spark.read.schema(STORED).parquet(*paths).where("sequence_id IS NOT NULL").select(*(x.split()[0] for x in PIECES.split(", ")))
