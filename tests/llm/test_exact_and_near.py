import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termsieve.llm import components, exact, simhash
from termsieve.llm.base import SWEEP, IdFilter, Scratch

from .edge import PROSE, TEXTS, docs, key

UP = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def low(t):
    return (t or "").translate(UP)


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def test_exact_groups(spark):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[low(t)].append(i)
    want = []
    for i, t in TEXTS:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_groups(docs(spark).repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_exact_merge_over_many_runs(spark):
    rows = [(i, f"text {i % 7}") for i in range(500)]
    got = exact.exact_groups(docs(spark, rows).repartition(37)).collect()
    assert {(r.doc_id % 7, r.keep_id, r.group_size) for r in got} == {(k, max(i for i in range(500) if i % 7 == k), len(range(k, 500, 7))) for k in range(7)}
    smallest = exact.exact_groups(docs(spark, rows).repartition(9), keep_largest=False).collect()
    assert {r.keep_id for r in smallest} == set(range(7))


def test_exact_keeps_one_of_each(spark):
    kept = exact.without_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    rows = kept.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(t) for _, t in TEXTS})
    assert {r.doc_id for r in rows} >= {6, 7, None} and 5 not in {r.doc_id for r in rows}


def test_exact_merges_sorted_runs(spark):
    """Every round sorts and merges equal neighbours; no hash aggregate, no Python."""
    rows = exact.digests(docs(spark).repartition(70))
    spark.conf.set(exact.SORTED, "true")
    try:
        one = exact.merge_round(rows.withColumnsRenamed({"doc_id": "keep_id"}).withColumn("group_size", exact.F.lit(1).cast("long")), True, 4)
        plan = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(exact.SORTED)
    assert "SortAggregate" in plan and "HashAggregate" not in plan and "Python" not in plan and "Arrow" not in plan
    assert spark.conf.get(exact.SORTED) == "false"


def test_exact_keeps_clashing_columns(spark):
    df = docs(spark).withColumnsRenamed({"kept": "__norm", "hits": "__ID", "mark": "__null"})
    kept = exact.without_copies(df)
    assert kept.columns == df.columns and {r["__norm"] for r in kept.collect()} == {"k"}


def test_exact_empty(spark):
    assert exact.exact_groups(docs(spark, [])).count() == 0 and exact.without_copies(docs(spark, [])).count() == 0


def fp3(t):
    w = low(t).encode().split()
    some = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    n = np.zeros(64, int)
    for s in some:
        h = xxhash.xxh64_intdigest(s, 42)
        n += [h >> k & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * n[k] > len(some))


def test_simhash_links(spark):
    rows = [(i, t) for i, t in TEXTS if t is None or len(t) < 20000]
    base = TEXTS[-1][1].split()
    rows += [(1000 + k, " ".join(base[:k] + ["CHANGED"] + base[k + 1 :])) for k in range(0, 40, 2)]
    # Two unrelated texts, each with a copy whose id is null; one id with two texts.
    rows += [(2005, PROSE[5] + " one"), (2009, PROSE[9] + " two"), (None, PROSE[5] + " one"), (None, PROSE[9] + " two"), (2005, PROSE[7] + " three")]
    prints = [(i, fp3(t)) for i, t in rows]
    parent: dict = {}
    values = sorted({p for _, p in prints})
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 2:
                parent[find(parent, a)] = find(parent, b)
    least: dict = {}
    for i, p in prints:
        r = find(parent, p)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = [(i, f"{p:016x}", least[find(parent, p)]) for i, p in prints]
    for crowd in (simhash.CROWD, 0, 2):
        got = simhash.link_groups(docs(spark, rows), crowd).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < len(values)


def test_near_pairs_of_a_family_with_one_half_in_common(spark):
    r = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    some = {(0xABCD1234 << 32) ^ sum(1 << r.randrange(34) for _ in range(r.randint(1, 4))) for _ in range(150)} | {(sum(1 << r.randrange(32) for _ in range(3)) << 32) | 77 for _ in range(150)}
    some = sorted(some)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(some) for b in some[:i] if bin(a ^ b).count("1") <= 2}
    classes = spark.createDataFrame([(signed(x),) for x in some], "fp long")
    for crowd in (10, 1000):
        got = [tuple(x) for x in simhash.near_pairs(classes, crowd=crowd).collect()]
        assert set(got) == want and len(got) == len(want) > 100


def test_simhash_zero_and_empty(spark):
    got = {r.doc_id: r for r in simhash.link_groups(docs(spark, [(5, None), (3, ""), (4, " \n")])).collect()}
    assert {r.fingerprint for r in got.values()} == {"0" * 16} and {r.component_id for r in got.values()} == {3}
    assert simhash.link_groups(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1, 40, components.EDGES])
def test_components_of_blocks(spark, most):
    rng = np.random.default_rng(most)
    for nodes, edges in ((500, 480), (3000, 1500), (60, 400)):
        pairs, parent, want = rng.integers(-nodes, nodes, (edges, 2)).tolist(), {}, {}
        pairs += [(k + 1, k) for k in range(2 * nodes, 2 * nodes + 90)] + [(None, 5), (6, None)]
        for a, b in pairs:
            if a is not None and b is not None and a != b:
                parent[find(parent, a)] = find(parent, b)
        for k in list(parent):
            want.setdefault(find(parent, k), []).append(k)
        want = sorted((k, min(own)) for own in want.values() for k in own)
        got = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(5), most=most)
        assert sorted(tuple(x) for x in got.collect()) == want


def test_small_components_take_few_tasks(spark):
    """What a driver remembers of tasks is most of its memory where there are many partitions."""
    own, sc = spark.newSession(), spark.sparkContext
    own.conf.set("spark.sql.shuffle.partitions", 50)
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    steps = np.random.default_rng(3).permutation(400).tolist()
    edges = own.createDataFrame(list(zip(steps, steps[1:])), "a long, b long").repartition(50)
    sc.setJobGroup("small-components", "")
    try:
        assert {r.root for r in components.components(edges).collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("small-components") for s in track.getJobInfo(j).stageIds}
    assert sum(info.numTasks for s in stages if (info := track.getStageInfo(s))) < 600


def near_rows(rows, words=5, least=0.8):
    """Groups (two rows at least) of the places of rows that are near copies, by comparing all pairs."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = low(t).encode().split()
        if w:
            sets[k] = {b" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))}
    parent: dict = {}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                parent[find(parent, a)] = find(parent, b)
    groups = defaultdict(list)
    for k in sets:
        groups[find(parent, k)].append(k)
    return [own for own in groups.values() if len(own) > 1]


def jaccard_groups(rows, words=5, least=0.8):
    """(id, smallest id of the group) of every row that has a near copy."""
    groups = [[rows[k][0] for k in own] for own in near_rows(rows, words, least)]
    return sorted(((i, min((x for x in own if x is not None), default=None)) for own in groups for i in own), key=key)


def near(spark, rows, **more):
    return sorted((tuple(r) for r in simhash.near_groups(docs(spark, rows), **more).collect()), key=key)


def test_near_groups(spark):
    rows = [(i, t) for i, t in TEXTS if t is None or len(t) < 5000]
    family = TEXTS[-2][1].split() * 2
    rows += [(2000 + k, " ".join(family[: 3 * k] + [f"new{k}"] + family[3 * k + 1 :])) for k in range(30)]  # one large family
    rows += [(3000, " ".join(family))]
    # Near copies without an id, and unrelated texts of one id.
    rows += [(None, PROSE[11] + " end"), (None, PROSE[12] + " end"), (111, PROSE[20] + " x"), (4000, PROSE[21]), (4000, PROSE[22]), (None, "alone " * 3), (None, PROSE[0] + PROSE[2])]
    want = jaccard_groups(rows)
    assert near(spark, rows) == want and len(want) > 30
    assert near(spark, rows, small=3) == want
    assert near(spark, []) == []
    kept = simhash.without_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert jaccard_groups(left) == []
    groups = len({g for _, g in want if g is not None}) + 1  # id 111 is the smallest of two
    assert len(left) == len(rows) - len(want) + groups
    assert {t for _, t in left} >= {PROSE[0] + PROSE[2], "alone " * 3}


def test_sketches_exclude_no_pair_that_is_alike(spark):
    r, sets = random.Random(3), []
    rows = [(k, " ".join(r.choice(PROSE).split()[r.randint(0, 9) :] + [f"z{i}" for i in range(r.choice((0, 3, 30, 700)))])) for k in range(60)] + [(60, ""), (61, "one")]
    got = {x.id: x.sketch for x in simhash.sketches(spark.createDataFrame(rows, "id long, text string"), 5).collect()}
    for _, t in rows:
        w = low(t).split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    excluded = 0
    for a in range(62):
        for b in range(a):
            alike = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            room = simhash.may_be_alike(got[a], got[b], 0.8)
            assert room or not alike
            excluded += not room
    assert excluded > 1000 and simhash.may_be_alike(None, got[1], 0.8)


def test_near_groups_of_block_edits(spark):
    """One block appended, cut off or replaced: similarity from 0.76 to 0.9, alone and in a family."""
    r, rows = random.Random(7), []
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]
    for k in range(40):
        base, n = text(200), r.choice((24, 34, 44, 48, 54))
        at = r.randint(0, 200 - n)
        rows += [(4 * k, base), (4 * k + 1, base + text(n)), (4 * k + 2, base[:-n]), (4 * k + 3, base[:at] + text(n // 2) + base[at + n // 2 :])]
    common = text(180)  # a family whose members have a block of their own
    rows += [(1000 + k, common + text(r.choice((20, 25, 60)))) for k in range(40)]
    rows = [(i, " ".join(t)) for i, t in rows]
    want = jaccard_groups(rows)
    for small in (simhash.SMALL, 3):
        assert near(spark, rows, small=small) == want and len(want) > 60


def test_near_groups_ask_for_no_distance(spark):
    """Pairs of similarity 0.8 whose fingerprints differ in 41 bits and more."""
    r, rows, bits = random.Random(11), [], []
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]
    prints = lambda t: int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(" ".join(t).encode(), 2), 4))
    while len(rows) < 24:
        base = text(200)
        other = base + text(45)
        n = bin(prints(base) ^ prints(other)).count("1")
        if n > 40:
            bits.append(n)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    assert near(spark, rows) == [(k, k - k % 2) for k in range(24)] and max(bits) > 44


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_written_tables_leave_no_shuffle_files(spark):
    scratch, before = Scratch(spark), shuffle_bytes(spark)
    one, two = (scratch.keep(spark.range(50_000).groupBy((F.col("id") * 7 % 9973).alias("k")).count(), w) for w in ("one", "two"))
    assert shuffle_bytes(spark) <= before and one.count() == two.count() == 9973
    assert spark.conf.get(SWEEP) == "false"
    scratch.drop("one")
    assert len(scratch.paths) == 1 and "termsieve-two-" in scratch.paths[0]
    scratch.drop()
    assert scratch.paths == []


def test_id_filter_misses_no_id(spark):
    ids = list(range(0, 300_000, 100)) + [-5, 1 << 62]
    wanted = IdFilter(spark.createDataFrame([(i,) for i in ids], "id long"))
    has = lambda some: wanted.has(np.array([r[0] for r in spark.createDataFrame([(i,) for i in some], "id long").select(wanted.place()).collect()]))
    assert has(ids).all() and has(range(1_000_001, 1_020_000)).mean() < 0.15
    none = IdFilter(spark.createDataFrame([], "id long"))
    assert not none.bits.any()


def test_near_groups_shuffle_no_texts(spark, monkeypatch):
    """Also where the table of candidates is too large to be sent to all tasks."""
    plans, keep = [], Scratch.keep

    def spied(self, df, what):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df, what)

    monkeypatch.setattr(Scratch, "keep", spied)
    rows = [(k, f"{PROSE[k % 20]} more {k}") for k in range(40)] + [(100 + k, f"{PROSE[30]} x{k} " + " ".join(f"w{k}{j}" for j in range(k))) for k in range(12)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert near(spark, rows, small=3) == jaccard_groups(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sets = [p for what, p in plans if what == "sets"]
    assert sets and not any("Exchange" in p or "Join" in p for p in sets)


def test_near_copies_are_found_by_their_fingerprints_first(spark, monkeypatch):
    """Groups by fingerprints of five-word shingles against all pairs; the search is left what they do not settle."""
    r = random.Random(5)
    bases = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)) for _ in range(12)]
    rows = [(10 * k + j, b if not j else b + f" e{j}" if j < 4 else b + " " + b[: 30 * j]) for k, b in enumerate(bases) for j in range(7)]
    texts = spark.createDataFrame([(i, t) for i, t in rows] + [(900, ""), (901, "")], "id long, text string")
    scratch, parent, want = simhash.Scratch(spark), {}, {}
    prints = {i: int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5))) for i, t in [*rows, (900, ""), (901, "")]}
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[find(parent, a)] = find(parent, b)
    for i in prints:
        want.setdefault(find(parent, i), []).append(i)
    pairs = simhash.print_pairs(texts, 5, scratch)
    got = {x.node: x.root for x in components.components(pairs).collect()}
    assert got == {i: own[0] for own in want.values() if len(own) > 1 for i in own} and len(got) > 12
    found = {tuple(x) for x in simhash.alike_pairs(texts, pairs, 5, 0.8, scratch).collect()}
    assert found and found <= {tuple(x) for x in pairs.collect()} and (900, 901) not in found
    scratch.drop()

    kept, keep = {}, simhash.Scratch.keep

    def spied(self, df, what):
        out = keep(self, df, what)
        kept.setdefault(what, []).append({tuple(x) for x in out.collect()} if what in ("links", "near") else None)
        return out

    monkeypatch.setattr(simhash.Scratch, "keep", spied)
    assert near(spark, rows) == jaccard_groups(rows)
    assert kept["links"][0] == found
    root = {x.node: x.root for x in components.components(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    assert kept["near"][0] and all(root.get(a, a) != root.get(b, b) for a, b in kept["near"][0])


def test_near_groups_bring_few_sets_to_pairs_at_once(spark, monkeypatch):
    """However many rows the large shingles have, and pairs the small ones: tables of sets and pairs are written in parts."""
    r, rows = random.Random(5), []
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]
    common = [text(30) for _ in range(6)]
    for k in range(60):  # members of several large shingles that are hardly ever alike
        rows.append((k, " ".join(sum((c for c in r.sample(common, 3)), []) + text(40))))
    rows += [(100 + k, rows[k][1] + " " + " ".join(text(6))) for k in range(0, 60, 3)]
    sides, links, keep = [], [], Scratch.keep

    def spied(self, df, what):
        out = keep(self, df, what)
        if what == "side":
            sides.append((out.select(F.sum(F.size("shingles"))).first()[0] or 0, {x.key for x in out.select("key").distinct().collect()}))
        elif what == "links":
            links.append(out)
        return out

    monkeypatch.setattr(Scratch, "keep", spied)
    monkeypatch.setattr(simhash, "SETS_BYTES", 1 << 18, raising=False)
    want = jaccard_groups(rows)
    assert near(spark, rows, small=3) == want and len(want) >= 40
    whole = sum(n for n, _ in sides)
    assert 2 < len(sides) < 9 and max(n for n, _ in sides) < whole / 2
    assert sum(len(some) for _, some in sides) == len(set().union(*(some for _, some in sides)))

    links.clear()
    monkeypatch.setattr(simhash, "SETS_BYTES", 1 << 13, raising=False)
    monkeypatch.setattr(simhash, "PORTION", 1 << 20, raising=False)
    pairs = spark.createDataFrame([(k, 100 + k + n) for k in range(0, 60, 3) for n in (0, 3)], "a long, b long")
    texts = spark.createDataFrame(rows, "id long, text string")
    got = simhash.alike_pairs(texts, pairs, 5, 0.8, Scratch(spark)).collect()
    assert len(links) > 1 and sorted(map(tuple, got)) == [(k, 100 + k) for k in range(0, 60, 3)]
