import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termsieve.llm import suffix

from .edge import SHARED, TEXTS, docs, key


def brute(texts, length):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]].append((d, s))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                cover[d][s : s + length] = True
    out = []
    for t, c in zip(texts, cover):
        runs = int((c & ~np.concatenate([[False], c[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(c.sum()), runs, hashlib.sha256(bytes(b for b, x in zip(t, c) if not x)).hexdigest()))
    return out


def mixed(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(50, 400))) for _ in range(10)]
    out = []
    for _ in range(50):
        t = ""
        for _ in range(r.randint(0, 6)):
            pick, b = r.random(), r.choice(base)
            at = r.randint(0, len(b))
            t += b if pick < 0.4 else b[at : at + r.randint(1, 200)] if pick < 0.6 else r.choice("ab") * r.randint(1, 150) if pick < 0.7 else "xyé " * r.randint(1, 60) if pick < 0.8 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 150)))
        out.append(t)
    return [*out, "", out[3], out[5]]


@pytest.mark.parametrize(("length", "heavy", "huge", "seed"), [(60, 4096, 9999, 1), (60, 1, 9999, 2), (100, 2, 2, 3), (60, 1, 1, 4)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, heavy, huge, seed):
    monkeypatch.setattr(suffix, "BATCH", 16)
    monkeypatch.setattr(suffix.repeated, "__defaults__", (length, heavy, huge))
    texts = mixed(seed)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeat_report(docs(spark, list(enumerate(texts))), length).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts], length)


def test_edges(spark):
    rows = [r for r in TEXTS if r[0] not in (3, 4, 19)]
    want = brute([(t or "").encode() for _, t in rows], 400)
    got = [tuple(r) for r in suffix.repeat_report(docs(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert {r[0] for r in got if r[2]} >= {11, 12, 13, 14, 103}


def test_long_and_periodic(spark):
    rows = [r for r in TEXTS if r[0] in (3, 4, 19)]
    got = {r.doc_id: r for r in suffix.repeat_report(docs(spark, rows)).collect()}
    assert (got[3].n_removed, got[3].n_spans) == (len(rows[0][1]), 1)  # its words repeat every 4001
    assert (got[4].n_removed, got[4].n_spans) == (300_000, 1)
    assert (got[19].n_removed, got[19].n_spans) == (15000, 1)


def test_repeated_rows_and_empty(spark):
    long = SHARED * 2
    got = suffix.repeat_report(docs(spark, [(1, long), (1, long), (2, "short")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, len(long)), (1, len(long)), (2, 0)]
    assert suffix.repeat_report(docs(spark, [])).count() == 0 and suffix.without_repeats(docs(spark, [])).count() == 0


def test_without_repeats_keeps_columns_and_characters(spark):
    shared = "é" * 150
    rows = [(1, "aß" + shared + "end"), (2, "xß" + shared), (3, None), (None, "left alone")]
    out = suffix.without_repeats(docs(spark, rows), 256)
    assert out.columns == docs(spark).columns and dict(out.dtypes) == dict(docs(spark).dtypes)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("aend", 4), 2: ("x", 1), 3: ("", 0), None: ("left alone", 10)}


def test_spans_of_equal_rows_are_gathered_once(spark):
    rows = lambda k: docs(spark, [(1, SHARED * 2)] * k + [(None, SHARED * 2), (None, "other " + SHARED), (None, "alone " * 90)])
    few, many = ({(r.k1, r.k2): sorted(map(tuple, r.hits)) for r in suffix.repeated(suffix.keyed(rows(k).repartition(3))).collect()} for k in (2, 60))
    assert few == many and len(few) == 3
    got = sorted((r.n_bytes, r.n_removed) for r in suffix.repeat_report(rows(5)).collect() if r.doc_id is None)
    assert got == sorted([(len(SHARED) * 2, len(SHARED) * 2), (len(SHARED) + 6, len(SHARED)), (540, 540)])


def test_only_runs_of_enough_words_go(spark):
    r = random.Random(8)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]
    rows = []
    for n in (40, 50, 51, 60):
        shared = text(n)
        rows += [(10 * n + k, " ".join(text(20) + shared + text(20)), " ".join(shared)) for k in range(2)]
    out = {r.doc_id: r.text for r in suffix.without_repeats(docs(spark, [x[:2] for x in rows]), 150, 50).collect()}
    for i, full, shared in rows:
        assert (shared in out[i]) == (i < 510) and (i >= 510 or out[i] == full)
    data = np.frombuffer(b" ab cd  efg h", np.uint8)
    assert suffix.words_in(data, np.array([0, 2, 1, 4, 5]), np.array([13, 13, 5, 6, 5])).tolist() == [4, 3, 1, 1, 0]


def test_clashing_columns_stay(spark):
    df = docs(spark, [(1, "a " + SHARED * 2), (2, "b " + SHARED * 2), (3, "c")]).withColumnsRenamed({"hits": "__hits", "mark": "__k1", "kept": "__K2"})
    out = suffix.without_repeats(df)
    assert out.columns == df.columns and {(r.doc_id, r.text, r["__hits"]) for r in out.collect()} == {(1, "a", 0), (2, "b", 1), (3, "c", 2)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=12), min_size=1, max_size=6), min_size=1, max_size=5))
def test_merge_sort_orders_strings(groups):
    items = [x.encode() for g in groups for x in g]
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    order, lcp = suffix.ordered(items, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert [items[i] for i in order[a:b]] == sorted(items[a:b])
        assert lcp[a] == -1
        for k in range(a + 1, b):
            x, y = items[order[k - 1]], items[order[k]]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_hash_collisions_are_caught(monkeypatch):
    monkeypatch.setattr(suffix, "prefix_hash", lambda data: np.zeros(len(data) + 1, dtype=np.uint64))
    items = [b"b", b"a", b"ab", b"aa"]
    order, lcp = suffix.ordered(items, np.array([0, 4]))
    assert [items[i] for i in order] == sorted(items) and lcp.tolist() == [-1, 1, 1, 0]
