"""Joins, aggregates, windows, top-k and set operations shared by the query packs.

Join strategy is left to Catalyst and adaptive execution: sides get broadcast from measured sizes and
skewed partitions of sort-merge joins are split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from tideline.operators.ordered import numbered, top_n_per_group
from tideline.operators.pages import rows_between

# ---- filters -----------------------------------------------------------------


def bind_query(spark: SparkSession, sql: str, args: dict | list | None = None, **views: DataFrame) -> DataFrame:
    """Parameterised SQL over the given frames; values are bound, never pasted."""
    return spark.sql(sql, args=args, **views)


def like_filter(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.filter(F.col(col).like(pattern))


def contains_filter(df: DataFrame, parts: dict[str, str | None]) -> DataFrame:
    """Case-insensitive contains per column; blank texts do not filter."""
    for c, text in parts.items():
        if text:
            df = df.filter(F.lower(F.col(c)).contains(text.lower()))
    return df


# ---- joins -------------------------------------------------------------------


def inner_join_chain(dfs: list[DataFrame], conds: list) -> DataFrame:
    return reduce(lambda left, right: left.join(right[0], right[1], "inner"), zip(dfs[1:], conds), dfs[0])


def left_join(a: DataFrame, b: DataFrame, cond) -> DataFrame:
    return a.join(b, cond, "left")


def semi_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b, keys, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b, keys, "left_anti")


def cross_constants(df: DataFrame, values: list, name: str) -> DataFrame:
    """Every row once per constant: a generator, not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def digit_table(spark: SparkSession, places: int) -> DataFrame:
    """The numbers a cross join of ``places`` digit tables yields."""
    return spark.range(10**places).select(F.col("id").cast("int").alias("idx"))


def scalar_subquery_join(outer: DataFrame, inner: DataFrame, keys: list[str], agg: Column) -> DataFrame:
    """Correlated scalar aggregate: the inner side is aggregated once per key, then joined."""
    return outer.join(inner.groupBy(*keys).agg(agg), keys, "left")


# ---- aggregates --------------------------------------------------------------


def global_aggs(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"), F.avg(col).alias("mean"))


def group_agg(df: DataFrame, keys: list, aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def expr_agg(df: DataFrame, keys: list, expr: Column, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(expr).alias(name))


def having(df: DataFrame, keys: list, aggs: list[Column], cond: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs).filter(cond)


def count_distinct(df: DataFrame, keys: list, cols: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(n) for n, c in cols.items()])


# ---- windows over calendar keys ----------------------------------------------


def month_index(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("long")


def calendar_range_avg(df: DataFrame, month: str, value: str, back: int = 2, by: list[str] = ()) -> DataFrame:
    """Mean over the months present in [m - back, m]. ``df`` holds one row per month (and ``by``)."""
    w = W.partitionBy(*by).orderBy(month).rangeBetween(-back, 0)
    return df.withColumn("rolling_avg", F.avg(value).over(w))


def calendar_prev_delta(df: DataFrame, month: str, value: str, by: list[str] = ()) -> DataFrame:
    """Difference to the calendar month before; NULL when that month has no row."""
    w = W.partitionBy(*by).orderBy(month).rangeBetween(-1, -1)
    return df.withColumn("delta_prev", F.col(value) - F.max(value).over(w))


def rank_over_agg(df: DataFrame, keys: list[str], agg: Column, name: str, k: int) -> DataFrame:
    """First ``k`` groups by the aggregate, with RANK() over all groups.

    The filter on the rank lets Spark cut every task to its first k groups before the ordered window.
    """
    totals = df.groupBy(*keys).agg(agg.alias(name))
    ranked = totals.withColumn("rank", F.rank().over(W.orderBy(F.desc(name)))).filter(F.col("rank") <= k)
    return ranked.orderBy("rank", *keys).limit(k)


def row_number_top(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    return top_n_per_group(df, part, order, n)


def rownum_limit(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rownum_page(df: DataFrame, lo: int, hi: int, order: list) -> DataFrame:
    """Rows lo..hi (1-based) of the ordered table with their number."""
    lo = max(lo, 1)
    rows = rows_between(df, lo - 1, hi, order)
    return rows.withColumn("rownum", F.row_number().over(W.orderBy(*order)) + F.lit(lo - 1))  # the rows of the page


def offset_delta(samples: DataFrame, by: list[str], ts: str, value: str, seconds: int = 60) -> DataFrame:
    """Value minus the value exactly ``seconds`` earlier in the same series.

    An equi join on (series, ts): samples are spread over the cluster however long one series is.
    """
    shift = F.make_interval(secs=F.lit(seconds))
    earlier = samples.select(*by, (F.col(ts) + shift).alias(ts), F.col(value).alias("_before"))
    return samples.join(earlier, [*by, ts]).withColumn("delta", F.col(value) - F.col("_before")).drop("_before")


# ---- sort, limit, paging -----------------------------------------------------


def order_by(df: DataFrame, cols: list) -> DataFrame:
    return df.orderBy(*cols)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_instant(samples: DataFrame, ts: str, order: list[Column], k: int = 5) -> DataFrame:
    return top_n_per_group(samples, [ts], order, k)


def page(df: DataFrame, page_no: int, size: int, order: list) -> DataFrame:
    """One page; totals come from :func:`page_totals`, so listing a page does not count the table."""
    page_no, size = max(page_no, 1), max(size, 1)
    return rows_between(df, (page_no - 1) * size, page_no * size, order)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    size = max(size, 1)
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(size)).cast("long")
    )


def nulls_last_sort(df: DataFrame, col: str, *more) -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last(), *more)


def result_blocks(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """Rows with their 0-based position and the block of ``n`` they are delivered in."""
    out = numbered(df, [], order, "_rn")
    pos = F.col("_rn") - 1
    return out.select(*df.columns, pos.alias("pos"), F.floor(pos / n).cast("long").alias("block"))


def deliver_blocks(df: DataFrame, order: list, n: int = 100) -> Iterator[list[Row]]:
    """Hand rows over in blocks of ``n``, one partition at a time on the driver."""
    block: list[Row] = []
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        block.append(row)
        if len(block) == n:
            yield block
            block = []
    if block:
        yield block


# ---- sets --------------------------------------------------------------------


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def union_distinct_ci(*dfs: DataFrame, col: str = "name") -> DataFrame:
    """Names unique ignoring case; the spelling of the earliest frame wins, then the smallest one."""
    tagged = [d.select(F.col(col).alias("_n"), F.lit(i).alias("_src")) for i, d in enumerate(dfs)]
    return (
        reduce(DataFrame.union, tagged)
        .groupBy(F.lower("_n").alias("key"))
        .agg(F.min(F.struct("_src", "_n"))["_n"].alias(col))
    )


def except_(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def distinct(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing (a NULL reference has no parent either)."""
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


