"""Findings of texts that were checked before are taken over; only new ones are checked."""

import os
import shutil

from termsieve.config import Market, RuleConfig, RuleVersion
from termsieve.operators import evaluate, incremental

A = RuleVersion(1, "A", 1, RuleConfig(canonical="Lumenza", disallowed=("lumen prime",)))
B = RuleVersion(2, "B", 3, RuleConfig(canonical="Kelvin", locales={"el": Market(("Κέλβιν",), ("Κελβιν",)), "fr": Market(("Celvine",))}, cross_market="high"))
TEXTS = ["lumenza", "Lumenza is right", "lumen prime", "nothing here", "kelvin and lumenza", "Κελβιν", "Κέλβιν", ""]


def tables(spark, texts, languages=("en", "el", None)):
    rows = [(k % 2 + 1, k % 6, k, t, "visible" if k % 11 else "spoken", "m") for k, t in enumerate(texts)]
    assets = [(a % 2 + 1, a, languages[a % len(languages)], "ok" if a != 5 else "failed", None) for a in range(6)]
    return spark.createDataFrame(rows, "run_id int, asset_id int, segment_id int, text string, visibility string, market string").drop("market"), spark.createDataFrame(assets, "run_id int, asset_id int, language string, status string, found_on_id int")


def rows_of(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def step(spark, path, texts, rules, **more):
    segments, assets = tables(spark, texts, **more)
    got, want = incremental.evaluate_new(segments, assets, rules, path), evaluate.evaluate_run(segments, assets, rules)
    assert set(got.findings.columns) == set(want.columns)
    assert rows_of(got.findings, want.columns) == rows_of(want, want.columns)
    return got.checked


def test_only_new_texts_are_checked(spark, tmp_path):
    path, many = str(tmp_path / "answers"), [TEXTS[k % 8] for k in range(60)]
    keys = lambda texts: {(bytes(r.digest), r.market) for r in incremental.keyed(*tables(spark, texts)).collect()}
    first = step(spark, path, many, [A, B])
    assert first == len(keys(many)) and step(spark, path, many, [A, B]) == 0
    changed = [t + " Lumenzza" if k % 10 == 0 else t for k, t in enumerate(many)]
    assert step(spark, path, changed, [A, B]) == len(keys(many) | keys(changed)) - first > 0
    assert step(spark, path, changed, [A, B]) == 0 and step(spark, path, many, [A, B]) == 0
    # A new version of a rule is checked against all texts, the other rule against none; a rule that is off counts for nothing.
    newer = A.changed(RuleConfig(canonical="Lumenza", disallowed=("nothing here",)))
    assert step(spark, path, many, [newer, B]) == first and step(spark, path, many, [newer]) == 0
    assert step(spark, path, many, [RuleVersion(1, "A", 9, A.config, enabled=False), B]) == 0
    # The market is part of what was checked, the language as it is written is not.
    assert step(spark, path, many, [A, B], languages=("en-GB", "el", None)) == 0
    assert step(spark, path, many, [A, B], languages=("fr", "el", None)) > 0


def test_the_number_of_texts_checked(spark, tmp_path):
    """A tenth of the segments has another text in the second run: so many texts are checked, and no more."""
    path = str(tmp_path / "answers")
    one = [f"line {k} of lumenza" for k in range(200)]
    two = [f"{t} lumenzza" if k % 10 == 3 else t for k, t in enumerate(one)]
    used = lambda texts: incremental.keyed(*tables(spark, texts, languages=("en",))).count()
    assert step(spark, path, one, [A], languages=("en",)) == used(one)
    n = step(spark, path, two, [A], languages=("en",))
    assert 0 < n <= 20 and n == sum(1 for r in incremental.keyed(*tables(spark, two, languages=("en",))).collect() if r.text.endswith("zza"))


def test_a_pass_that_was_not_finished_does_not_count(spark, tmp_path):
    path = str(tmp_path / "answers")
    n = step(spark, path, TEXTS * 3, [A, B])
    [only] = os.listdir(path)
    shutil.copytree(f"{path}/{only}/findings", f"{path}/pass-000000002/findings")
    assert step(spark, path, TEXTS * 3, [A, B]) == 0
    os.remove(f"{path}/{only}/keys/_SUCCESS")
    for name in os.listdir(path):
        if name not in (only, "pass-000000002"):
            shutil.rmtree(f"{path}/{name}")
    assert step(spark, path, TEXTS * 3, [A, B]) == n


def test_dead_keys_go(spark, tmp_path):
    path = str(tmp_path / "answers")
    step(spark, path, TEXTS * 3, [A, B])
    step(spark, path, ["other lumenza"] * 5, [A, B])
    step(spark, path, TEXTS[:2] * 6, [A])
    segments, assets = tables(spark, TEXTS[:2] * 6)
    incremental.expired(segments, assets, [A], path)
    assert len(os.listdir(path)) == 1
    answers = incremental.Answers(spark, path)
    assert {r.rule_id for r in answers.keys().collect()} == {1} and answers.keys().select("digest").distinct().count() == 2
    assert step(spark, path, TEXTS[:2] * 6, [A]) == 0 and step(spark, path, ["other lumenza"] * 5, [A]) > 0
    incremental.expired(segments, assets, [A], path)
    assert step(spark, path, TEXTS[:2] * 6, [A]) == 0
