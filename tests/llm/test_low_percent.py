"""Jaccard join with a percent below the registered one: partners of very different sizes in large families."""

from __future__ import annotations

import random

import pytest

from tests.llm.helpers import sentence
from tests.llm.test_texts import shingles
from tideline.llm import jaccard_join


@pytest.mark.parametrize("percent", [50, 65])
def test_partners_of_other_sizes(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 3)  # every family is large
    rng = random.Random(percent)
    data = []
    for f in range(12):
        words = sentence(rng, 404).split()
        short = 4 + 400 * percent // 100 + 2
        data += [(100 * f + k, " ".join(words[: n]) + f" {f}x{k}") for k, n in enumerate([404, 404, 403, short, short, short + 1])]
    small = [sentence(rng, 10).split() for _ in range(40)]  # small sets share few of their first tokens
    data += [(5000 + 2 * i + j, " ".join(w if j else w[:-3])) for i, w in enumerate(small) for j in (0, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in data}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                one, two = sorted((group[a], group[b]))
                group = {d: one if g == two else g for d, g in group.items()}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, percent=percent).collect()}
    assert got == group


def test_reach():
    assert jaccard_join._reach(80) == 5 and jaccard_join._reach(50) == 15
