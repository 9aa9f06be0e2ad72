"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(40000))
SHARED = " ".join(f"shared{i * 31 % 97}" for i in range(80))
_r = random.Random(5)
PROSE = [" ".join(_r.choice(["the", "of", "and"]) if _r.random() < 0.3 else "".join(_r.choice(["th", "er", "on", "an", "re", "ti", "es"]) for _ in range(_r.randint(1, 5))) for _ in range(_r.randint(40, 160))) for _ in range(40)]

TEXTS = [
    (1, ""), (2, None), (None, "a row without an id"), (3, LONG), (4, "x" * 300_000), (5, "Same TEXT here, É é"), (6, "same text HERE, É é"), (6, "same text HERE, É é"), (7, "same text here, é é"),
    (8, " \t\n\x0b\x0c\r "), (9, "one"), (10, "one two"), (11, PROSE[0] + " " + SHARED), (12, PROSE[1] + " " + SHARED + " " + PROSE[2]), (13, PROSE[3]), (14, PROSE[3] + " tail"),
    (-15, "negative id 日本語 テキスト　全角"), (16, "line\nline\nline\n\n  \nother"), (17, "a b\x1cc ﻿ x"), (18, "<|endoftext|> and <|startoftext|> don't \\### x </turn>"), (19, "de " * 5000),
] + [(100 + i, p) for i, p in enumerate(PROSE)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, digest string, hits int, kept string, id int, fp string, role string, row_id int, mark int"


def docs(spark, rows=TEXTS):
    full = [(i, t, None if k % 3 else "en", "s", None if t is None else len(t), k, "d", k, "k", k, "f", "r", k, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows=TEXTS):
    out = [(i, 0 if i % 4 == 0 else 1, 0, "x") for i, _ in rows if i is not None and i >= 100] + [(None, 1, 0, "x"), (101, None, None, "x"), (102, 1, 0, "x"), (5000, 1, 1, "x")]
    return spark.createDataFrame(out, "doc_id long, quality int, toxic int, text string")


def key(row):
    return tuple((v is None, v) for v in row)
