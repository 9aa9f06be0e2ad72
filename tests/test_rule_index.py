"""Many rules at once, against each rule's own check of each text."""

import random

import pytest

from termsieve.config import Market, RuleConfig, RuleVersion
from termsieve.functions.spelling import Checker
from termsieve.functions.text import lowered, unusual
from termsieve.operators import evaluate, rule_index

RULES = [
    RuleConfig(canonical="Lumenza", allowed_casings=("LUMENZA",), disallowed=("Lumentza", "lumen prime", "c++ lib", "24/7"), max_edit_distance=2, ignore_words=("lumena",)),
    RuleConfig(canonical="Straße", disallowed=("strasse gasse",)),
    RuleConfig(canonical="Orbit", attached_forms_ok=False, disallowed=("orbitt",), severity="low"),
    RuleConfig(canonical="Ünïko", exceptions=("emails",)),
    RuleConfig(canonical="Ab", fuzzy=False),
    RuleConfig(canonical="Foo Bar", disallowed=("3m",)),
    RuleConfig(canonical="Kelvin", locales={"el": Market(("Κέλβιν",), ("Κελβιν",)), "ja": Market(("ケルビン",), ("ケル ビン",))}, cross_market="high"),
    RuleConfig(canonical="X9"),
]
PIECES = [
    "Lumenza", "lumenza", "LUMENZA", "Lumetnza", "lmenz", "Lumena", "Lumentza", "Lumen Prime", "lumen\nprime", "lumen www.q.test/a prime", "lu menza", "Lu-Menza", "lum·enza", "lu‐menza", "lu  menza", "MiniLumenzaMax", "c++ lib", "C++  LIB", "24/7", "124/7",
    "Strasse", "STRASSE", "straße", "Strase", "stra ße", "strasse Gasse", "ﬁne", "orbit", "Orbitt", "xorbit", "orbıt", "orbİt", "oRbIt", "Or​bit", "Or­bit", "ｏｒｂｉｔ", "üniko", "ÜNÏKO", "Ünïko", "unïko", "ünïko", "ab", "AB", "cab", "a b", "foobar", "foo bar", "3M", "3mm",
    "Κέλβιν", "Κελβιν", "ΚΈΛΒΙΝ", "ケルビン", "ケル ビン", "Kelvin", "Kelvin", "kelvn", "kevlin", "thnghttps://x.test/orbit", "lumnzahttps://x.test", "awww.orbit.test", "a@orbit.test", "#orbit", "@lumenza", "orbit.pdf", "x9", "X 9", "日本", "…", "“orbit”", "orbit’s", "orbit_x", "orbit1", "é", "naïve",
]


def rows_of(spark, n, seed):
    r = random.Random(seed)
    texts = [*PIECES, None, "", "w" * 3000 + "lumenza" + "x" * 700, *("".join(r.choice(PIECES) + r.choice([" ", ", ", "-", "", ". ", "\t"]) for _ in range(r.randint(1, 6))) for _ in range(n))]
    rows = [(k, t, r.choice(["el", "ja", "en", None]), r.choice(["visible", "hidden", "spoken", None])) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame([(i, t, g, v, "x", 3) for i, t, g, v in rows], "id long, text string, language string, visibility string, word string, rule int")


def brute(rows, rules):
    return sorted((i, r.rule_id, h.kind, h.start, h.end, h.matched, h.expected, h.severity) for i, t, g, v in rows if t is not None and v != "spoken" for r in rules if r.enabled for h in Checker(r.config).check(t, g))


def found(df):
    return sorted((r.id, r.rule_id, r.kind, r.start, r.end, r.matched_text, r.expected, r.severity) for r in df.collect())


def versions(configs):
    return [RuleVersion(10 + k, f"r{k}", 1, c, enabled=k != 99) for k, c in enumerate(configs)]


def test_index_equals_each_rule_alone(spark):
    rows, df = rows_of(spark, 600, 1)
    rules = versions(RULES)
    out = rule_index.evaluate_many(df, rules)
    want = brute(rows, rules)
    assert found(out) == want and len(want) > 500
    assert set(out.columns) == set(evaluate.evaluate(df, rules).columns)


@pytest.mark.parametrize("k", range(len(RULES)))
def test_gate_equals_each_rule_alone(spark, k):
    rows, df = rows_of(spark, 300, 2)
    rules = versions(RULES)[k : k + 1]
    assert found(evaluate.evaluate(df, rules)) == brute(rows, rules)


def test_repeated_rows_stay_and_disabled_rules_do_not(spark):
    rows = [(1, "lumenza orbit", "en", "visible")] * 3
    df = spark.createDataFrame(rows, "id long, text string, language string, visibility string")
    rules = [*versions(RULES[:1]), RuleVersion(7, "off", 1, RULES[2], enabled=False)]
    assert found(rule_index.evaluate_many(df, rules)) == brute(rows, rules) and rule_index.evaluate_many(df, rules).count() == 3
    assert rule_index.evaluate_many(df, []).count() == 0 == rule_index.evaluate_many(df.limit(0), rules).count()


def test_many_names(spark):
    r = random.Random(3)
    name = lambda: "".join(r.choice("aeioubcdrst") for _ in range(r.randint(4, 9)))
    names = sorted({name().capitalize() for _ in range(200)})
    rules = versions(RuleConfig(canonical=n, max_edit_distance=1 + k % 2) for k, n in enumerate(names))

    def bent(n):
        i = r.randrange(len(n))
        return r.choice([n, n.lower(), n[:i] + n[i + 1 :], n[:i] + "é" + n[i:], n[:i] + " " + n[i:], n + "s", n[:i] + n[i + 1 : i + 2] + n[i : i + 1] + n[i + 2 :]])

    rows = [(k, " ".join(bent(r.choice(names)) if r.random() < 0.3 else name() for _ in range(12)), None, "visible") for k in range(150)]
    df = spark.createDataFrame(rows, "id long, text string, language string, visibility string")
    assert found(rule_index.evaluate_many(df, rules)) == brute(rows, rules)


def test_usual_texts_fold_alike_in_both(spark):
    """Of every character that built-in functions may judge: the JVM's folding is the check's."""
    every = [chr(n) for n in range(1, 0x2500) if not 0xD800 <= n < 0xE000]
    got = spark.createDataFrame([(c,) for c in every], "c string").select("c", unusual(rule_index.F.col("c")).alias("odd"), lowered(rule_index.F.col("c")).alias("low")).collect()
    usual = [g for g in got if not g.odd]
    assert len(usual) > 500 and all(rule_index.fold(g.c)[0].casefold() == g.low for g in usual)
    assert {"ı", "İ", "ſ", "ﬁ", "­", "Κ", "ª"} & {g.c for g in usual} == set()
