"""Search, facets, heat and ranking over a statement log.

Columns: id, sql, parameters, execution_time (ms), in_transaction, has_error, timestamp (ms), client_uuid,
conn_hash, method_name, normalized_sql, query_type, table_names (comma list).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.shape import json_or_text
from tideline.functions.sql_text import csv_items, explode_each, slow_query_id
from tideline.operators.ordered import best_per_key, numbered
from tideline.operators.pages import rows_between

KEYWORD_COLUMNS = ["sql", "normalized_sql", "parameters", "method_name"]
TRANSLATION_SCHEMA = "queryId string, originalSql string, translatedSql string, connHash string, updateTime bigint"


def _has_text(s: str | None) -> bool:
    return bool(s and s.strip())


def _text(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "") != ""


def keyword_search(df: DataFrame, keyword: str | None, cols: list[str] = KEYWORD_COLUMNS) -> DataFrame:
    if not _has_text(keyword):
        return df
    hits = [F.coalesce(F.lower(F.col(c)).contains(keyword.lower()), F.lit(False)) for c in cols]
    return df.filter(reduce(lambda a, b: a | b, hits))


def min_time_filter(df: DataFrame, min_ms: int | None = None) -> DataFrame:
    return df if min_ms is None or min_ms <= 0 else df.filter(F.col("execution_time") >= min_ms)


def type_filter(df: DataFrame, query_type: str | None = None) -> DataFrame:
    if not _has_text(query_type):
        return df
    return df.filter(F.lower(F.coalesce(F.col("query_type"), F.lit(""))) == query_type.lower())


def csv_member_filter(df: DataFrame, col: str, name: str | None) -> DataFrame:
    if not _has_text(name):
        return df
    return df.filter(F.exists(csv_items(col), lambda x: F.lower(x) == name.lower()))


def slow_query_search(
    df: DataFrame,
    conn_hash: str | None = None,
    keyword: str | None = None,
    min_ms: int | None = None,
    query_type: str | None = None,
    table: str | None = None,
) -> DataFrame:
    if _has_text(conn_hash):
        df = df.filter(F.col("conn_hash") == conn_hash)
    df = keyword_search(df, keyword)
    df = min_time_filter(df, min_ms)
    df = type_filter(df, query_type)
    return csv_member_filter(df, "table_names", table)


def slow_query_page(df: DataFrame, page: int, size: int, **filters) -> DataFrame:
    """One page, slowest first, each row with the total and the number of pages."""
    page, size = max(page, 1), max(size, 1)
    hits = slow_query_search(df, **filters)
    total = hits.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = rows_between(hits, (page - 1) * size, page * size, [F.desc("execution_time"), "id"])
    return (
        rows.withColumn("total", total)
        .withColumn("total_pages", F.ceil(F.col("total") / F.lit(size)).cast("long"))
    )


def exploded_tables(log: DataFrame, *keep: str, distinct_per_row: bool = True) -> DataFrame:
    """One row per table of a statement's list."""
    items = csv_items("table_names")
    return explode_each(log, F.array_distinct(items) if distinct_per_row else items, "table", *keep)


def facet_lists(log: DataFrame) -> DataFrame:
    """Distinct non-blank connections, types and tables as (facet, value), plus the row total.

    Long form: the lists grow with the data, so they are rows and not one array. Statements are counted
    per connection, type and table list first, in one pass over the log; lists are taken apart and the
    total is summed over these few rows.
    """
    shapes = log.groupBy("conn_hash", "query_type", "table_names").agg(F.count(F.lit(1)).alias("n"))
    facets = F.concat(
        F.when(_text("conn_hash"), F.array(F.struct(F.lit("connection").alias("facet"), F.col("conn_hash").alias("value"))))
        .otherwise(F.array().cast("array<struct<facet:string,value:string>>")),
        F.when(_text("query_type"), F.array(F.struct(F.lit("type").alias("facet"), F.col("query_type").alias("value"))))
        .otherwise(F.array().cast("array<struct<facet:string,value:string>>")),
        F.transform(csv_items("table_names"), lambda t: F.struct(F.lit("table").alias("facet"), t.alias("value"))),
    )
    rows = explode_each(shapes, facets, "f").select("f.*").distinct()
    total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("value")).select(F.lit("total").alias("facet"), "value")
    return rows.unionByName(total)


def group_to_list(log: DataFrame, key: str, order: list[str], block: int = 1000) -> DataFrame:
    """Statements of each group as lists of at most ``block``; small groups have the one block 0."""
    placed = numbered(log, [key], order, "_rn")
    item = F.struct(*[F.col(c) for c in [*order, *[c for c in log.columns if c not in (key, *order)]]])
    return (
        placed.withColumn("block", F.floor((F.col("_rn") - 1) / block).cast("long"))
        .groupBy(key, "block")
        .agg(F.array_sort(F.collect_list(item)).alias("statements"))
    )


def tables_by_connection(log: DataFrame, conn: str | None = None) -> DataFrame:
    """Sorted unique tables per connection; a connection without tables keeps an empty list.

    Names are made distinct before they are collected, so a list is as long as the catalogue of its
    connection however many statements name the tables.
    """
    rows = log.filter(_text("conn_hash"))
    if conn is not None:
        rows = rows.filter(F.col("conn_hash") == conn)
    names = rows.select("conn_hash", F.explode_outer(csv_items("table_names")).alias("table")).distinct()
    return names.groupBy("conn_hash").agg(F.array_sort(F.collect_list("table")).alias("tables"))


def slowest_per_statement(log: DataFrame, min_ms: int = 1000, methods: tuple[str, ...] = ("executeQuery",)) -> DataFrame:
    """Per statement id the run with the largest time; of equal times the earlier one.

    A run counts when it is slow, or when it failed as a query. The largest times are found first, so
    a statement that makes up most of the log is no hot spot and only the runs that reach them are compared.
    """
    failed_query = F.coalesce(F.col("has_error"), F.lit(False)) & F.col("method_name").isin(*methods)
    # a failed call is kept only by way of the query method, whatever its time
    kept = log.filter(
        F.when(F.coalesce(F.col("has_error"), F.lit(False)), failed_query).otherwise(F.col("execution_time") >= min_ms)
    )
    kept = kept.withColumn("statement_id", slow_query_id("conn_hash", "sql"))
    best = best_per_key(kept, ["statement_id"], "execution_time", [F.asc("timestamp"), F.desc("id")])
    return best.select("statement_id", *log.columns)


def table_heat(log: DataFrame, k: int = 5) -> DataFrame:
    """Statements per table name. Names count once per mention; blank elements of a list count as ''."""
    items = F.transform(F.split(F.nullif("table_names", F.lit("")), ","), lambda x: F.trim(x))
    names = explode_each(log, items, "table")
    return names.groupBy("table").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "table").limit(k)


def share_by_connection(log: DataFrame, k: int = 5) -> DataFrame:
    """Rounded percentage of all statements per connection (halves round up)."""
    name = F.coalesce(F.nullif(F.col("conn_hash"), F.lit("")), F.lit("Unknown"))
    total = log.agg(F.count(F.lit(1)).alias("total")).scalar()
    counts = log.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "name").limit(k)
    return top.withColumn("percent", F.floor(F.col("n") / total * 100 + 0.5).cast("long"))


def translation_listing(
    df: DataFrame, search: str | None = None, conn: str | None = None, key: str = "key", raw: str = "raw"
) -> DataFrame:
    """Stored translations, JSON or legacy plain text; newest first, those without a time last."""
    parsed = df.filter(F.col(raw).isNotNull()).select(
        F.col(key).alias("_key"), F.trim(raw).alias("_raw"), json_or_text(raw, TRANSLATION_SCHEMA, "translatedSql").alias("r")
    )
    legacy = ~F.col("_raw").startswith("{")
    rows = parsed.select(
        F.when(legacy, F.col("_key")).otherwise(F.col("r.queryId")).alias("query_id"),
        F.when(legacy, "").otherwise(F.col("r.originalSql")).alias("original_sql"),
        F.col("r.translatedSql").alias("translated_sql"),
        F.when(legacy, "").otherwise(F.col("r.connHash")).alias("conn_hash"),
        F.col("r.updateTime").alias("update_time"),
    )
    if _has_text(search):
        needle = search.lower()
        rows = rows.filter(
            F.coalesce(F.lower("original_sql").contains(needle), F.lit(False))
            | F.coalesce(F.lower("translated_sql").contains(needle), F.lit(False))
        )
    if _has_text(conn):
        rows = rows.filter(F.lower("conn_hash").contains(conn.lower()))
    return rows.orderBy(F.col("update_time").desc_nulls_last(), "query_id")
