import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from termsieve.llm import resample
from termsieve.llm.nptext import Chunk

from .edge import LONG, PROSE, TEXTS, docs, key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def buckets(t):
    w = WORD.findall(lower(t))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, goal):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text)[1])
    for text in goal:
        t.update(buckets(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, text in rows:
        w, f = buckets(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=key)


def check(spark, rows, goal):
    target = spark.createDataFrame([(k, t, "x") for k, t in enumerate(goal)], "item_id long, text string, score string")
    got = resample.resample(docs(spark, rows), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == brute(rows, goal)


def test_draws_equal_brute_force(spark):
    check(spark, TEXTS, [PROSE[3], None, "", PROSE[7][:200]])


def test_copies_share_scores_and_ids_decide(spark):
    """Rows of one id have one noise: equal texts then tie, and ties go by id and features."""
    rows = [(k % 40, PROSE[k % 5]) for k in range(300)] + [(None, PROSE[0])] * 30 + [(k, "few words") for k in range(50)]
    check(spark, rows, [PROSE[1]])


def test_no_target_no_rows_no_draws(spark):
    check(spark, TEXTS, [])
    check(spark, [], [PROSE[0]])
    check(spark, [(1, PROSE[0]), (2, "a b")], [PROSE[0]])  # a quarter of one row is none


def test_crc_of_words_and_pairs():
    texts = ["a", "word " * 3, "é日本", "x" * 64, "y" * 65, "z" * 5000 + " q " + "w" * 200, LONG, ""]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    c = Chunk(data, off, True, resample.BREAK)
    bucket, doc = resample.features(c)
    for k, t in enumerate(texts):
        assert Counter(bucket[doc == k].tolist()) == Counter(buckets(t)[1])


def test_draw_moves_towards_the_target(spark):
    near = [(k, PROSE[2] + f" more{k}") for k in range(200)]
    far = [(1000 + k, PROSE[9] + f" more{k}") for k in range(200)]
    target = spark.createDataFrame([(k, PROSE[2]) for k in range(200)], "item_id long, text string")  # beside BUCKETS of smoothing
    drawn = [r.doc_id for r in resample.resample(docs(spark, near + far), target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(i < 1000 for i in drawn) > 70
