import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from termsieve.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, vector string, slot int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, "v", 2) for i, v, lab in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    """Searches through all entries, on Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept else 0
    size = width // parts
    used = [r for r in kept if len(r[1]) == width]
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in used[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in used:
                of[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(lambda: None)
    for i, v, lab in kept:
        got = [near(x, books[p]) for p, x in enumerate(cut(v))] if len(v) == width else None
        error = sum(d for d, _ in got) if got else None
        if got:
            by_label[lab] = (by_label[lab] or 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in got) if got else None, error, lab))
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=repr)


def rows_of(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(n, width, seed, spread=1.0):
    r = random.Random(seed)
    return [(k * 7 % (n + 11), [r.gauss(0, spread) for _ in range(width)], r.choice([1, 2, None])) for k in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(500, 32, 1)
    rows += [(k, v, 9) for k, v, _ in rows[:60]]  # repeated rows, and ids with other labels
    rows += [(5000, None, 1), (5001, [math.nan] + [0.0] * 31, 1), (5002, [None] + [0.0] * 31, 1), (5003, [math.inf] + [0.0] * 31, 1), (None, [0.25] * 32, 3), (-4, [0.5] * 32, None)]
    assert rows_of(codes.compress(table(spark, rows))) == brute(rows)


def test_coarse_grid_makes_ties(spark):
    """Few distinct values: entries coincide and distances tie everywhere, so the lowest index must win."""
    r = random.Random(4)
    rows = [(k, [r.choice([0.0, 1 / 256, 2 / 256]) for _ in range(32)], k % 3) for k in range(400)]
    assert rows_of(codes.compress(table(spark, rows))) == brute(rows)


def test_few_vectors_and_other_lengths(spark):
    few = vectors(5, 16, 3)
    assert rows_of(codes.compress(table(spark, few))) == brute(few)
    mixed = vectors(100, 16, 6) + [(3, [0.5] * 8, 1), (400, [], 2), (401, [1.0] * 32, 77)]
    got = rows_of(codes.compress(table(spark, mixed)))
    assert got == brute(mixed) and sum(r[1] is None for r in got) == 3
    empty = [(1, [], 1), (2, [], 1)]
    assert rows_of(codes.compress(table(spark, empty))) == brute(empty)
    assert rows_of(codes.compress(table(spark, []))) == [] == rows_of(codes.compress(table(spark, [(1, None, 1)])))


def test_other_parameters(spark):
    rows = vectors(300, 12, 8, 3.0)
    assert rows_of(codes.compress(table(spark, rows), parts=3, entries=200, rounds=4)) == brute(rows, 3, 200, 4)
    with pytest.raises(ValueError):
        codes.compress(table(spark, rows), parts=5)


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        codes.compress(table(spark, [(1, [1e12] * 16, 1)])).collect()


@pytest.mark.parametrize("spread", [2, 40, 100000])
def test_kd_tree_finds_the_lowest_of_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries, points = rng.integers(0, spread, (64, 4)), rng.integers(-spread, 2 * spread, (3000, 4))
    at, best = codes.KdTree(entries).nearest(points)
    distance = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
