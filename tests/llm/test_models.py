import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from termsieve.llm import linear, lm, nbsvm, rules
from termsieve.llm.nptext import Chunk

from .edge import LONG, PROSE, TEXTS, docs, key, labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))


def test_rule_counts_equal_brute_force(spark):
    got = rules.quality_rules(docs(spark), labels(spark)).collect()
    want = []
    for i, t in TEXTS:
        c = counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (not r.base_failed and r.quality_score >= rules.THRESHOLD) for r in got)


def test_rules_keep_rows_with_all_columns(spark):
    full, kept = rules.quality_rules(docs(spark), labels(spark)), rules.passing(docs(spark), labels(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(((i, t) for (i, t), k in zip(TEXTS, [None] * len(TEXTS)) if i in {r.doc_id for r in full.where("kept").collect()}), key=key)


def test_shapes_of_words():
    texts = ["a a b c", "x y x z x", "p q r s t", "a b", "", "z z z z z", "k l", "l k k l"]
    data = np.frombuffer(" ".join(texts).encode(), dtype=np.uint8)
    off = np.cumsum([0] + [len(t) + 1 for t in texts])
    off[-1] = len(data)
    c = Chunk(data, off)
    key, at = c.shapes(c.words(), 4)
    got = list(zip(c.word_doc[at].tolist(), key.tolist()))
    assert [d for d, _ in got] == [0, 1, 1, 5, 5, 7]  # aabc; xyxz, yxzx; zzzz twice; abba
    assert len({k for _, k in got}) == 5 and got[3][1] == got[4][1]


def quality_tables(spark, n=600):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(n):
        w = " ".join(rng.permutation(PROSE[i % 40].split())[:60])
        good = bool(rng.random() < 0.7)
        rows.append((i, w if good else " ".join(x + ["###", "***", "&&&"][k % 3] for k, x in enumerate(w.split()))))
        marks.append((i, int(good)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"), dict(marks)


def test_held_out_accuracy(spark):
    d, marks, truth = quality_tables(spark)
    got = nbsvm.classify(d, marks).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = {r.doc_id: r.kept for r in rules.quality_rules(d, marks, rows=300).collect()}
    assert np.mean([kept[i] == bool(t) for i, t in truth.items()]) > 0.97


GOLD, TURN, INVERSE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25
M = (1 << 64) - 1


def mixed(h):
    for _ in range(2):
        h = (h ^ h >> 32) * TURN & M
    return h ^ h >> 32


def poly(b):
    return sum((x + 1) * pow(GOLD, j, 1 << 64) for j, x in enumerate(b)) & M


def hashed(text):
    """(words, pairs, runs of four bytes, runs of three characters) as the features' numbers, one string at a time."""
    t = (text or "").encode()
    words = [mixed(poly(w) + len(w) & M) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    pairs = [mixed(a * INVERSE + b & M) for a, b in zip(words, words[1:])]
    chars = [c.encode() for c in t.decode()]
    three = [b"".join(chars[k : k + 3]) for k in range(len(chars) - 2)]
    return words, pairs, [mixed(poly(t[k : k + 4])) for k in range(len(t) - 3)], [mixed(poly(g) + len(g) & M) for g in three]


def bin_of(key):
    return ((key & M) * GOLD & M) >> 64 - nbsvm.BITS


def few(rows):
    return [(i, t if t is None else t[:400]) for i, t in rows]


def test_classifier_scores_equal_brute_force(spark):
    """The model is fitted apart; every score is that of a set of strings and a dictionary of weights."""
    d, marks, _ = quality_tables(spark, 150)
    rows = few(TEXTS)
    where = nbsvm.crc_mod(nbsvm.F.col("doc_id"), 5) != 0
    r, wr, b, slope, offset = nbsvm.fit(d.unionByName(docs(spark, rows)), marks, where=where)
    got = nbsvm.classify(d.unionByName(docs(spark, rows)), marks).where("doc_id IS NULL OR doc_id NOT BETWEEN 20 AND 149 OR doc_id > 100").collect()
    texts = [(x.doc_id, x.text) for x in d.unionByName(docs(spark, rows)).where("doc_id IS NULL OR doc_id NOT BETWEEN 20 AND 149 OR doc_id > 100").collect()]
    want = []
    for i, t in texts:
        words, pairs, four, _ = hashed(t)
        bins = {bin_of(k) for k in words + pairs} | {bin_of(k + 1) for k in four}
        length = math.sqrt(sum(float(r[k]) ** 2 for k in bins))
        margin = sum(float(wr[k]) for k in bins) / max(length, 1e-9) + b
        want.append((i, 1 / (1 + math.exp(-min(max(slope * margin + offset, -35), 35)))))
    assert len(got) == len(want) and len(got) > 60
    for (i, p), x in zip(sorted(want, key=key), sorted(((x.doc_id, x.score) for x in got), key=key)):
        assert x[0] == i and abs(x[1] - p) < 1e-6


def test_rule_verdicts_equal_brute_force(spark):
    d, marks, _ = quality_tables(spark, 150)
    rows = few(TEXTS)
    every = d.unionByName(docs(spark, rows))
    w, b, slope, offset = rules.fit(every, marks)
    want = []
    for i, t in [(x.doc_id, x.text) for x in every.collect()]:
        words, pairs, _, three = hashed(t)
        margin = b
        for some in ([bin_of(k) for k in words + pairs], [bin_of(k + 1) for k in three]):
            margin += rules.SCALE * sum(float(w[k]) for k in some) / max(1, len(some))
        p = 1 / (1 + math.exp(-min(max(slope * margin + offset, -35), 35)))
        c = counts(t)
        want.append((i, p, not (c[0] < 10 or 100 * c[4] > 20 * c[0]) and p >= rules.THRESHOLD))
    got = sorted(((x.doc_id, x.quality_score, x.kept) for x in rules.quality_rules(every, marks).collect()), key=key)
    for x, y in zip(got, sorted(want, key=key), strict=True):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-6 and (x[2] == y[2] or abs(y[1] - rules.THRESHOLD) < 1e-6)


def test_character_grams_are_of_code_points():
    texts = ["aé日b", "", "éé", "xyz日本語", "日"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    got, doc = Chunk(data, off).char_grams(3)
    for k, t in enumerate(texts):
        assert got[doc == k].tolist() == hashed(t)[3]


def test_shapes_are_a_parameter(spark):
    d, marks, truth = quality_tables(spark, 200)
    plain, shaped = ({x.doc_id: x.score for x in nbsvm.classify(d, marks, shape=n).collect()} for n in (0, 4))
    assert plain != shaped and plain == {x.doc_id: x.score for x in nbsvm.classify(d, marks).collect()}


def test_held_out_labels_teach_nothing(spark):
    d, marks, truth = quality_tables(spark, 200)
    wrong = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()], "doc_id long, quality int")
    a = {r.doc_id: r.score for r in nbsvm.classify(d, marks).collect()}
    assert a == {r.doc_id: r.score for r in nbsvm.classify(d, wrong).collect()}


def test_models_on_edges(spark):
    got = nbsvm.classify(docs(spark), labels(spark)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    empties = {r.score for r in got if r.doc_id in (1, 2, 8)}
    assert len({round(s, 12) for s in empties if s is not None}) <= 2
    none = labels(spark).where("false")
    assert {r.score for r in nbsvm.classify(docs(spark), none).collect()} == {0.5}
    assert all(r.kept == (not r.base_failed) for r in rules.quality_rules(docs(spark), none).collect())
    empty = docs(spark, [])
    assert nbsvm.classify(empty, labels(spark)).count() == rules.quality_rules(empty, labels(spark)).count() == rules.passing(empty, labels(spark)).count() == 0


def test_dual_descent_separates_and_meets_its_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w, b = nbsvm.dual_descent(rows, y, 5, cost=10, rounds=400)
    assert (np.sign(x @ w + b) == y).mean() > 0.95
    lo = 0.5 * (w @ w + b * b) + 10 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    for k in range(5):
        for step in (-0.01, 0.01):
            v = w.copy()
            v[k] += step
            assert 0.5 * (v @ v + b * b) + 10 * np.maximum(0, 1 - y * (x @ v + b)).sum() >= lo - 0.05


def test_logistic_and_platt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    s = linear.Sparse.of([(np.arange(3), v) for v in x], 3)
    w, b = linear.logistic(s, y, rounds=400)
    assert w[0] > 1 and w[1] < -0.4 and abs(w[2]) < 0.5
    a, c = linear.platt(3 * (x @ w + b), y)
    assert 0.2 < a < 0.6


def lm_by_hand(rows):
    tok = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for _, t in rows]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i, _ in rows]

    def gather(keep):
        u, b, t, n = Counter(), Counter(), Counter(), 0
        for w, f in zip(tok, fold):
            if keep(f):
                u.update(w)
                b.update(zip([0, *w[:-1]], w))
                t.update(zip([0, *w[:-2]], w[:-1], w[1:]))
                n += 1
        return u, b, t, Counter(u) + Counter({0: n})

    level = lambda c: 0 if c == 0 else int(math.floor(math.log2(c))) + 1

    def learn(pairs):
        seen: dict = {}
        for c, ratio in pairs:
            if c:
                seen.setdefault(level(c), []).append(ratio)
        weights, last = [0.0] * 48, 0.5
        for k in range(1, 48):
            if k in seen:
                r, last = np.array(seen[k]), 0.5
                for _ in range(100):
                    last = min(max(float((last * r / (last * r + 1 - last)).mean()), 1e-6), 1 - 1e-6)
            weights[k] = last
        return weights

    u, b, t, c = gather(lambda f: f not in (2, 3))
    n, v = sum(u.values()), len(u)
    one = lambda x: (u[x] + 1) / (n + v + 1)
    of = lambda top, context: top / context if context else 0.0
    mix2 = lambda h, x: w2[level(c[h])] * of(b[h, x], c[h]) + (1 - w2[level(c[h])]) * one(x)
    # A text's first token has no trigram.
    mix3 = lambda g, h, x: mix2(h, x) if g is ... else w3[level(b[g, h])] * of(t[g, h, x], b[g, h]) + (1 - w3[level(b[g, h])]) * mix2(h, x)
    triples = lambda w: zip([..., 0, *w[:-2]], [0, *w[:-1]], w)
    held = [w for w, f in zip(tok, fold) if f == 3]
    w2 = learn((c[h], of(b[h, x], c[h]) / one(x)) for w in held for _, h, x in triples(w))
    w3 = learn((b[g, h], of(t[g, h, x], b[g, h]) / mix2(h, x)) for w in held for g, h, x in triples(w) if g is not ...)
    u, b, t, c = gather(lambda f: f != 2)
    n, v = sum(u.values()), len(u)
    out = []
    for (i, _), w, f in zip(rows, tok, fold):
        out.append((i, f == 2, len(w), sum(u[x] > 0 for x in w), n, sum(math.log10(one(x)) for x in w), sum(math.log10(mix3(*x)) for x in triples(w))))
    return out


@pytest.mark.parametrize("block", [500, 1 << 21])
def test_lm_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", 2000)
    rows = [r for r in TEXTS if r[0] not in (4,)]
    got, want = sorted(map(tuple, lm.score(docs(spark, rows)).collect()), key=key), sorted(lm_by_hand(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 for g, w in zip(got, want))
    assert all(abs(g[6] - w[6]) <= 0.01 * abs(w[6]) for g, w in zip(got, want))


def test_lm_totals_beyond_32_bits(spark):
    keys = np.array([5, 9], dtype=np.uint64)
    rows = [(0, 0, b, 0, lm.squeeze_keys(keys), lm.squeeze(np.array([3_000_000_000, 1], dtype=np.uint32))) for b in range(3)]
    got = lm.answered(spark.createDataFrame(rows, lm.ASKED)).collect()
    assert {tuple(lm.unsqueeze(bytes(r.total), np.int64)) for r in got if r.block is not None} == {(9_000_000_000, 3)}
    assert [(r.n, r.v) for r in got if r.block is None] == [(9_000_000_003, 2)]


def test_lm_small_tables(spark):
    assert lm.score(docs(spark, [])).count() == 0
    test_only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.score(docs(spark, [(i, "a b") for i in test_only])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got} == {(3, 0, 0, 0.0)}
    assert len(LONG) > 100_000
