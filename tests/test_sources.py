"""Snapshot planning, catalogue listing, global quantiles."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tideline.operators.ordered import exact_quantiles
from tideline.session import shared_dir
from tideline.sources import catalog as ct, snapshot as sn


class Reader:
    """Stands in for a JDBC reader: keeps the options, answers the bounds query."""

    def __init__(self, bounds, opts=None):
        self.bounds, self.opts = bounds, dict(opts or {})

    def format(self, name):
        return Reader(self.bounds, {**self.opts, "format": name})

    def options(self, **kw):
        return Reader(self.bounds, {**self.opts, **kw})

    def option(self, k, v):
        return self.options(**{k: v})

    def load(self):
        return self

    def first(self):
        return self.bounds


class Session:
    def __init__(self, bounds):
        self.read = Reader(bounds)


@pytest.mark.parametrize("rows, parts", [(1, 1), (8096, 1), (8097, 2), (80_960, 10), (10**9, 123_518)])
def test_key_ranges(rows, parts):
    got = sn.snapshot_read(Session((5, 99, rows)), "shop.orders", "id", jdbc={"url": "jdbc:x"}).opts
    assert got["numPartitions"] == str(parts) and got["lowerBound"] == "5" and got["upperBound"] == "99"
    assert got["dbtable"] == "shop.orders" and got["partitionColumn"] == "id"


def test_empty_or_keyless_tables_are_read_whole():
    for reader in (sn.snapshot_read(Session((None, None, 0)), "t", "id", jdbc={}), sn.snapshot_read(Session(None), "t", jdbc={})):
        assert "partitionColumn" not in reader.opts and reader.opts["dbtable"] == "t"


def test_split_plan(spark):
    df = spark.createDataFrame([(1, 9, n) for n in (0, 1, 8096, 8097)], "lower int, upper int, rows bigint")
    assert [r["partitions"] for r in sn.plan_splits(df).orderBy("rows").collect()] == [1, 1, 1, 2]


def test_listing_of_a_database(spark):
    path = shared_dir(spark, "t-table")
    spark.range(3).select(F.col("id").alias("A"), F.lit("x").alias("b")).write.option("path", path).saveAsTable("tideline_listing")
    try:
        tables = ct.schema_tables(spark, "DEFAULT")
        rows = ct.table_catalog(spark, {"Zed": tables["tideline_listing"], "alpha": tables["tideline_listing"]}).collect()
        assert [(r["table_name"], r["ordinal"], r["column_name"]) for r in rows] == [("alpha", 1, "A"), ("alpha", 2, "b"), ("Zed", 1, "A"), ("Zed", 2, "b")]
    finally:
        spark.sql("DROP TABLE tideline_listing")


def test_sink_modes(spark):
    keys = ct.key_catalog(spark.createDataFrame([("T", 2, "b"), ("t", 1, "a"), ("NoKey", 0, None)], "table_name string, key_seq int, column_name string"))
    tables = spark.createDataFrame([("T",), ("NOKEY",), ("other",)], "table_name string")
    got = {r["table_name"]: (r["key_columns"], r["mode"]) for r in ct.sink_mode(tables, keys).collect()}
    assert got == {"T": ("a,b", "upsert"), "NOKEY": ("", "append"), "other": (None, "default")}


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_global_quantiles(hot, n):
    values = [(i * 37 % 101) / 4 for i in range(n)]
    df = hot.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = exact_quantiles(df, [], "x", {"p50": 0.5, "p0": 0.0, "p100": 1.0}).first()
    assert got["p50"] == pytest.approx(statistics.median(values)) and got["p0"] == min(values) and got["p100"] == max(values)
