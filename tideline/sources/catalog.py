"""Table listings and key information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LISTING = "table_name string, ordinal int, column_name string, type string, nullable boolean, column_default string, remark string"


def table_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of the given tables in order; tables sorted ignoring case. Reads schemas, not rows."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable, None, f.metadata.get("comment", ""))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, LISTING).orderBy(F.lower("table_name"), "ordinal")


def schema_tables(spark: SparkSession, schema: str | None = None) -> dict[str, DataFrame]:
    """Tables of a database of the session catalogue; its name is matched ignoring case."""
    names = {d.name.lower(): d.name for d in spark.catalog.listDatabases()}
    db = names.get((schema or spark.catalog.currentDatabase()).lower(), schema)
    return {t.name: spark.table(f"`{db}`.`{t.name}`") for t in spark.catalog.listTables(db) if not t.isTemporary}


def key_catalog(keys: DataFrame) -> DataFrame:
    """(table_name, key_seq, column_name) -> key columns in sequence as a comma list, per lower-case table.

    A row without a column stands for a table known to have no key and gives ''.
    """
    cols = F.array_sort(F.collect_list(F.when(F.col("column_name").isNotNull(), F.struct("key_seq", "column_name"))))
    return keys.groupBy(F.lower("table_name").alias("table_name")).agg(
        F.array_join(F.transform(cols, lambda s: s["column_name"]), ",").alias("key_columns")
    )


def _mode(key_columns: Column) -> Column:
    return (
        F.when(key_columns.isNull(), "default").when(F.trim(key_columns) == "", "append").otherwise("upsert")
    )


def sink_mode(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """upsert with a key, append when it is known that there is none, default when nothing is known."""
    named = tables.withColumn("_k", F.lower("table_name"))
    known = keys.select(F.col("table_name").alias("_k"), "key_columns")
    return named.join(known, "_k", "left").select("table_name", "key_columns", _mode(F.col("key_columns")).alias("mode"))
