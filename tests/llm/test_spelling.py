"""Spelling variants against brute force: every pair compared, roots followed one by one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents, empty
from tideline.llm import spelling
from tideline.llm.queries import QUERIES


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word) and c != word[i]:
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def brute_counts(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def brute_forms(counts):
    letters, forms, near = sorted({c for w in counts for c in w}), {}, {}
    for w, n in counts.items():
        near[w] = {x for x in edits(w, letters) if x in counts and x != w}
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return out


def rows_of(df):
    got = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed", range(6))
def test_ranges_reach_every_near_word(seed):
    rng = random.Random(seed)
    alphabet = ["abc", "abcdefgh", "aé×ÿz中"][seed % 3]
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 8))) for _ in range(700)})
    near = defaultdict(set)
    for w in words:
        near[w] = {x for x in edits(w, alphabet) if x in set(words) and x != w}
    for length in range(5, 9):
        held = [w for w in words if len(w) == length]
        if not held:
            continue
        box = spelling.Box(held, np.ones(len(held), np.int64))
        for other in (length - 1, length, length + 1):
            asked = [w for w in words if len(w) == other]
            if asked:
                i, j = box.near(asked)
                pairs = {(asked[a], held[b]) for a, b in zip(i, j)}
                assert len(pairs) == len(i) and pairs == {(w, x) for w in asked for x in near[w] if len(x) == length}


@pytest.mark.parametrize("box_words", [4, 40, spelling.BOX_WORDS])
def test_forms_and_roots(spark, box_words):
    rng = random.Random(box_words)
    counts = {}
    for _ in range(60):
        word, n = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))), rng.choice([64, 500, 512])
        for _ in range(rng.randint(1, 8)):  # a chain of rarer and rarer spellings, some of equal n
            counts[word] = n
            n = max(3, n // rng.choice([1, 2, 3]))
            k = rng.randrange(len(word))
            word = word[:k] + rng.choice("abcé") + word[k + rng.randint(0, 1) :]
    counts = {w: n for w, n in counts.items() if w} | {"".join(rng.sample("abcdeabc", 8)): 3 for _ in range(150)} | {"abcde" * 300: 9, "abcde" * 299 + "abcd": 3}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").selectExpr("*", "'clash' AS length", "1 AS box")
    assert rows_of(spelling.spelling_forms(df, box_words=box_words)) == brute_forms(counts)


def test_counts_of_documents(spark):
    docs = documents(spark, extra=True)
    more = [(900, "Été ÉTÉS étés Hello hello HELLO heLLo helo hellos × ÷ ab×cdef 12abcde34abcde"), (900, "hello"), (None, "hello " * 2000)]
    docs = docs.select("doc_id", "text", "h", "n").union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1", "2"))
    want = brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert want and {r["word"]: r["n"] for r in spelling.run_counts(docs).collect()} == want
    assert rows_of(spelling.spelling_forms(spelling.run_counts(docs))) == brute_forms(want)


def test_no_words(spark):
    assert spelling.spelling_forms(spelling.run_counts(empty(spark))).count() == 0
    odd = spark.createDataFrame([(None, 5), ("", 9), ("alone", 3)], "word string, n long")
    assert rows_of(spelling.spelling_forms(odd)) == {("alone", None, "alone", 3, 0, None)}


def test_query(spark):
    from tests.conftest import SMALL

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_spelling"](spark, SMALL)) == brute_forms(brute_counts(rows))
