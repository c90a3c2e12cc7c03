"""Initial full read of a table, in key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values -------------------------------------------------------------
SPLIT_ROWS = 8096
FETCH_SIZE = 500
# ------------------------------------------------------------------------------


def plan_splits(bounds: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """lower, upper, rows -> the number of key ranges that hold about ``split_rows`` rows each."""
    wanted = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(split_rows)))
    return bounds.withColumn("partitions", wanted.cast("long"))


def key_bounds(df: DataFrame, pk: str) -> DataFrame:
    return df.agg(F.min(pk).alias("lower"), F.max(pk).alias("upper"), F.count(F.lit(1)).alias("rows"))


def snapshot_read(
    spark: SparkSession, table: str, pk: str | None = None, split_rows: int = SPLIT_ROWS, jdbc: dict | None = None
) -> DataFrame:
    """Full read of a parquet path, or of a database table when ``jdbc`` holds url and properties.

    A database table with a numeric key is read in parallel key ranges; the bounds come from one
    aggregate query that the database answers.
    """
    if jdbc is None:
        return spark.read.parquet(table)  # parallel by file split already
    reader = spark.read.format("jdbc").options(**{"fetchsize": str(FETCH_SIZE), **jdbc})
    if pk is None:
        return reader.option("dbtable", table).load()
    query = f"(SELECT MIN({pk}) AS lower_key, MAX({pk}) AS upper_key, COUNT(*) AS n FROM {table}) b"
    lo, hi, n = reader.option("dbtable", query).load().first()
    if not n:
        return reader.option("dbtable", table).load()
    parts = max(1, -(-n // split_rows))
    ranges = {"partitionColumn": pk, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(parts)}
    return reader.options(dbtable=table, **ranges).load()
