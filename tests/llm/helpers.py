"""Small inputs with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéñstr") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, seed: int = 3, extra: bool = False):
    """Near copies, exact copies, shared passages, repeated rows, null and empty texts, one very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        rows.append([i, sentence(rng, rng.randint(1, 150)) + ".\n" + sentence(rng, 20)])
    for i in range(60, 90):
        words = rows[rng.randrange(40)][1].split(" ")
        if words and rng.random() < 0.8:
            words[rng.randrange(len(words))] = "zzz"
        rows.append([i, " ".join(words)])
    passage = sentence(rng, 90)
    for i in range(90, 100):
        rows.append([i, sentence(rng, 30) + " " + passage + " " + sentence(rng, 30)])
    rows += [[100, None], [101, ""], [102, " \n\t "], [103, "12 34 !!"], [104, rows[3][1]], [104, rows[3][1]], [None, rows[4][1]], [105, "spam " * 3000], [106, "The End"], [107, "tHe eND"], [3, sentence(rng, 40)]]
    langs = ["xx", "yy", None]
    out = [(d, t, langs[k % 3], None if k % 17 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(out, DOCS)
    return df.selectExpr("*", "1 AS class", "2 AS h", "3 AS pid", "4 AS n", "5 AS t", "'x' AS words") if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)
