"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

A text is cut at its special-token strings, then into chunks (an optional space and what follows up
to white space, or a run of white space). Chunks not met before are cut into pretokens and encoded
together: the symbols of all of them lie in one flat array, every round finds each pretoken's
adjacent pair of lowest rank by binary search over the sorted pair keys, and merges all its
occurrences from left to right, until no pretoken has a pair left. What a chunk encodes to is kept
in a table of bounded size, so memory follows neither the vocabulary of the corpus nor a partition.

Decoding goes from ids to bytes by the vocabulary, joins them and reads them as UTF-8.

Defined results: null or empty text has no ids (the digests are those of the empty string); ids may
be null or repeated; every input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import text_rows
from .kept import LETTERS, Kept, held, others_go
from .nptext import buffers

#: Chunks whose ids a worker keeps.
KEPT = 800_000
#: Bytes of new chunks that are merged at once.
MERGE_BYTES = 1 << 20

# The public pretokenising pattern of this vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CHUNK = re.compile(rb" ?" + LETTERS + rb"| ?[^\s]+|\s+(?!\S)|\s+")
# White space that bytes patterns do not know, in UTF-8, and the bytes it begins with.
_WIDE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MAYBE_WIDE = re.compile(rb"[\x1c-\x1f\xc2\xe1\xe2\xe3]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else 256 + k."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(ids.values(), default=0) + 1
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        #: Sorted pair keys, and the rank and the product of each.
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        symbol = byte_symbols()
        self.of_byte = np.array([ids[symbol[b]] for b in range(256)], dtype=np.int64)
        byte = {c: b for b, c in symbol.items()}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t for t, i in self.special.items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.split = regex.compile(PRETOKEN)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the pretokens, by rounds over all of them at once."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        none = np.int64(1) << 40
        while len(sym):
            pair = np.full(len(sym), -1, dtype=np.int64)
            inner = word[1:] == word[:-1]
            pair[:-1][inner] = sym[:-1][inner] * self.size + sym[1:][inner]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            hit = self.key[at] == pair if len(self.key) else np.zeros(len(sym), bool)
            rank = np.where(hit, self.rank[at] if len(self.key) else 0, none)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, begins)
            count = np.diff(np.append(begins, len(sym)))
            low = np.repeat(lowest, count)
            open_ = low < none
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            if not open_.any():
                break
            merge = hit & (rank == low) & open_
            # Of overlapping occurrences (a a a) every second one counts, from the left.
            run = np.flatnonzero(merge)
            if len(run):
                fresh = np.concatenate([[True], run[1:] != run[:-1] + 1])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
                merge[run[(np.arange(len(run)) - first) % 2 == 1]] = False
            sym = np.where(merge, self.made[at], sym)
            keep = open_.copy()
            keep[1:] &= ~merge[:-1]
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        return np.split(sym, np.searchsorted(word, np.arange(1, len(words)))) if words else []

    def pretokens(self, chunk: bytes) -> list[bytes]:
        return [p.encode() for p in self.split.findall(chunk.decode("utf-8", "replace"))]


class Codec:
    """Texts to ids and back, with a bounded table of chunks."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.kept = Kept(self.learn, KEPT)

    def chunks(self, raw: bytes) -> list[bytes]:
        """Special-token strings and chunks, in order. A part with white space beyond ASCII is one
        chunk, since only the full pattern can tell how its runs are cut."""
        v, out = self.vocabulary, []
        for k, part in enumerate(v.cut.split(raw) if v.cut and b"<" in raw else [raw]):
            if k % 2:
                out.append(part)
            elif not _MAYBE_WIDE.search(part) or not _WIDE_SPACE.search(part):
                out += _CHUNK.findall(part)
            elif part:
                out.append(part)
        return out

    def learn(self, new: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids joined by commas, decoded bytes) of each chunk."""
        v, out, i = self.vocabulary, [], 0
        while i < len(new):
            words, owner, size, j = [], [], 0, i
            while j < len(new) and (size < MERGE_BYTES or j == i):
                p = [] if new[j] in v.special else v.pretokens(new[j])
                words += p
                owner.append(len(p))
                size += len(new[j])
                j += 1
            ids, at = v.encode_words(words), 0
            for chunk, n in zip(new[i:j], owner):
                own = np.concatenate(ids[at : at + n]).tolist() if n else [v.special[chunk]] if chunk in v.special else []
                at += n
                back = b"".join(map(v.bytes.__getitem__, own))
                out.append((b",".join(b"%d" % x for x in own), chunk if back == chunk else back))
            i = j
        return out

    def encode(self, raws: list[bytes]):
        """(ids joined by commas, number of ids, decoded bytes) of each text."""
        for lo in range(0, len(raws), 64):
            some = [self.chunks(r) for r in raws[lo : lo + 64]]
            kept = self.kept.of(set().union(*some))
            for s in some:
                got = list(map(kept.__getitem__, s))
                ids, back = b",".join([g[0] for g in got]), b"".join([g[1] for g in got])
                yield ids, ids.count(b",") + 1 if ids else 0, back.decode("utf-8", "replace").encode()


def codec(path: str) -> Codec:
    others_go("bpe")
    mine = held("bpe")
    if path not in mine:
        mine[path] = Codec(path)
    return mine[path]


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. The path must be readable on every executor."""

    def run(batches):
        c = codec(vocabulary_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw = data.tobytes()
            rows = [(n, sha(ids), sha(back)) for ids, n, back in c.encode([raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())])]
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.kept.rest()

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
