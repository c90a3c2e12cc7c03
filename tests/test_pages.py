"""Pages by index against slices of the sorted list."""

from __future__ import annotations

import re as regex

import pytest
from pyspark.sql import functions as F

from tideline.operators import pages, relational as re


@pytest.fixture
def small_slices(spark):
    spark.conf.set("tideline.slice.rows", "500")
    yield spark
    spark.conf.unset("tideline.slice.rows")


def numbers(spark, n):
    return spark.range(n).select((F.col("id") * 7919 % 10_007).alias("a"), "id").withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a")))


@pytest.mark.parametrize("falling", [False, True])
def test_pages_of_any_depth(small_slices, falling):
    order = [F.desc("a"), F.asc("id")] if falling else ["a", "id"]
    df = numbers(small_slices, 20_000)
    want = [r["id"] for r in df.orderBy(*order).collect()]
    index = pages.page_index(df, order)
    assert index.total() == 20_000 and index.starts.count() >= 20
    for page_no, size in [(1, 10), (2, 333), (1000, 20), (1001, 20), (3, 499), (2, 2500), (20_000, 1), (7, 3000)]:
        got = index.page(page_no, size)
        assert [r["id"] for r in got.collect()] == want[(page_no - 1) * size : page_no * size]
    assert [r["id"] for r in index.page(0, 0).collect()] == want[:1]


def test_a_deep_page_reads_one_or_two_slices(small_slices):
    index = pages.page_index(numbers(small_slices, 20_000), ["a", "id"])
    for page_no in (1, 500, 1000):
        plan = index.page(page_no, 20)._jdf.queryExecution().executedPlan().toString()
        read = regex.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
        assert 1 <= len(set(regex.findall(r"(?<![#\w])\d+", read))) <= 2, read


def test_deep_pages_of_the_operators(small_slices, monkeypatch):
    monkeypatch.setattr(pages, "SHALLOW_ROWS", 100)
    df = numbers(small_slices, 3000)
    want = [r["id"] for r in df.orderBy("a", "id").collect()]
    assert [r["id"] for r in re.page(df, 20, 100, ["a", "id"]).collect()] == want[1900:2000]
    got = re.rownum_page(df, 2991, 4000, ["a", "id"]).collect()
    assert [(r["rownum"], r["id"]) for r in got] == list(enumerate(want[2990:], start=2991))
    assert re.page(df.limit(0), 90, 100, ["a", "id"]).count() == 0
