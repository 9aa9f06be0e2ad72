import importlib
import random
import re
from collections import defaultdict

import pytest

from termsieve.llm import registry, rules

from .. import compare
from .edge import PROSE, TEXTS, docs, key, labels
from .test_exact_and_near import low, near_rows
from .test_models import counts
from .test_text import check_packing


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_equals_its_sql(spark, sf_dir, name):
    assert compare.differences(registry.queries()[name](spark, sf_dir), compare.connection(sf_dir), registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_operator_covers_its_table(spark, sf_dir, name):
    out = registry.queries()[name](spark, sf_dir)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def passages_cut(texts, length, words):
    """What is left of each text: repeated runs of more than `words` whole words go, narrowed to whole characters."""
    raws = [t.encode() for t in texts]
    seen = defaultdict(list)
    for d, t in enumerate(raws):
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]].append((d, s))
    cover = [bytearray(len(t)) for t in raws]
    for places in seen.values():
        for d, s in places if len(places) > 1 else ():
            cover[d][s : s + length] = b"\1" * length
    out = []
    for t, c in zip(raws, cover):
        kept, at = b"", 0
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        for m in re.finditer(b"\1+", bytes(c)):
            lo, hi = m.span()
            if sum(lo <= a and b <= hi for a, b in spans) > words:
                while lo < hi and t[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi > lo and hi < len(t) and t[hi] & 0xC0 == 0x80:
                    hi -= 1
                kept, at = kept + t[at:lo], hi
        out.append((kept + t[at:]).decode())
    return out


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    corpus = importlib.import_module("corpus_pipeline")
    r = random.Random(9)
    passage = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(56))
    rows = [t for t in TEXTS if len(t[1] or "") < 20_000]
    rows += [(5000, PROSE[39] + " extra"), (5001, PROSE[39]), (5002, PROSE[39].upper()), (None, PROSE[30] + " more"), (5003, PROSE[31] + " " + passage), (5004, passage + " " + PROSE[32][5:]), (5005, PROSE[33]), (5005, PROSE[34] + " é")]
    rows += [(6000 + k, PROSE[k] + " end") for k in range(40)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs(spark).columns
    before, names = [(i, t) for i, t in rows], []
    for name, stage in corpus.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        names.append(name)
        if name == "quality_rules":
            verdict = {(v.doc_id, v.n_words, v.word_chars): v.kept for v in rules.quality_rules(now, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
            want = [(i, t) for i, t in before if verdict[(i, *counts(t)[:2])] and counts(t)[0] >= 10 and 100 * counts(t)[4] <= 20 * counts(t)[0]]
            assert 20 < len(want) < len(rows)
        elif name == "exact_dedup":
            best: dict = {}
            for i, t in before:
                if low(t) not in best or (best[low(t)][0] is None or i is not None and i > best[low(t)][0]):
                    best[low(t)] = (i, t)
            want = list(best.values())
        elif name == "near_dedup":
            lost = {k for own in near_rows(before) for k in own} - {min(own, key=lambda k: key(before[k][:1])) for own in near_rows(before)}
            want = [row for k, row in enumerate(before) if k not in lost]
            assert len(lost) > 2
        elif name == "passage_dedup":
            want = list(zip([i for i, _ in before], passages_cut([t for _, t in before], corpus.PASSAGE, corpus.PASSAGE_WORDS)))
            assert not any(passage in t for _, t in want) and any(passage in t for _, t in before)
        else:
            got = out.collect()
            assert check_packing(before, got) == 0 and len({x.sequence_id for x in got}) > 0
            break
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns
        got = [(x.doc_id, x.text) for x in now.collect()]
        assert sorted(got, key=key) == sorted(want, key=key), name
        if name == "passage_dedup":
            assert all(x.n_chars == len(x.text) for x in now.collect())
        before = got
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "passage_dedup", "pack"] and corpus.ORACLE_SQL is None


def test_pipeline_on_an_empty_table(spark, tmp_path):
    corpus = importlib.import_module("corpus_pipeline")
    now = docs(spark, [])
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0


def test_run_leaves_its_result_only(spark, sf_dir):
    corpus, base = importlib.import_module("corpus_pipeline"), importlib.import_module("termsieve.llm.base")
    mark = base.made()
    out = corpus.run(spark, sf_dir)
    assert base.made() == mark + 1 and out.count() > 0
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_passages_of_very_short_words_go(spark):
    """51 words of one or two letters that two documents share, whatever stands around them."""
    corpus, r = importlib.import_module("corpus_pipeline"), random.Random(8)
    short = [" ".join(r.choice("abcdefgh") + r.choice(["", r.choice("xyz")]) for _ in range(51)) for _ in range(3)]
    own = lambda: " ".join("".join(r.choice("klmnopq") for _ in range(r.randint(4, 9))) for _ in range(60))
    kept = [own() for _ in range(8)]
    rows = [(k, f"{kept[k]} {short[k % 3]} {own()}" if k < 6 else kept[k]) for k in range(8)]
    out = corpus.passage_dedup(spark, docs(spark, rows), None).collect()
    for x in out:
        assert x.text.startswith(kept[x.doc_id]) and not any(s in x.text for s in short)
        assert len(x.text.split()) <= 122
