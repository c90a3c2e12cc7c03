"""Block edges: 1, 99, 100, 101, 1000 and 10000 rows; row caps and pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideline.operators import relational as re
from tideline.plans import shop

SIZES = [1, 99, 100, 101, 1000, 10000]


def titles(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))


@pytest.mark.parametrize("n", SIZES)
def test_blocks_keep_order_and_are_complete(spark, n):
    blocks = list(re.deliver_blocks(titles(spark, n), ["id"]))
    assert [r["id"] for b in blocks for r in b] == list(range(n))
    assert all(len(b) == 100 for b in blocks[:-1]) and 1 <= len(blocks[-1]) <= 100


@pytest.mark.parametrize("n", SIZES)
def test_block_numbers(hot, n):
    got = {r["id"]: (r["pos"], r["block"]) for r in re.result_blocks(titles(hot, n), ["id"]).collect()}
    assert got == {i: (i, i // 100) for i in range(n)}


@pytest.mark.parametrize("n, asked, rows, cut", [(5, 5, 5, False), (5, 2, 2, True), (5, 0, 1, True), (201, None, 200, True), (200, 999, 200, False)])
def test_row_cap(spark, n, asked, rows, cut):
    out, flag = shop.bounded_query(spark, "SELECT * FROM {t} ORDER BY id;", asked, t=titles(spark, n))
    assert [r["id"] for r in out.collect()] == list(range(rows))
    assert flag.first().asDict() == {"row_count": rows, "truncated": cut}


@pytest.mark.parametrize("sql", ["", "  ", "DELETE FROM t", "select 1; select 2", "select 1;;", "update t set x = 1"])
def test_only_one_read_statement(spark, sql):
    with pytest.raises(ValueError):
        shop.bounded_query(spark, sql)


def test_page_ends(spark):
    df = titles(spark, 101)
    assert [r["id"] for r in re.page(df, 2, 100, ["id"]).collect()] == [100]
    assert re.page(df, 3, 100, ["id"]).collect() == []
    assert re.page_totals(df, 100).first().asDict() == {"total": 101, "total_pages": 2}
    assert [r["id"] for r in re.rownum_page(df, 11, 20, ["id"]).collect()] == list(range(10, 20))
