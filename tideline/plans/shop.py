"""Web-shop queries: users, products, orders, order_items, reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.operators.ordered import numbered
from tideline.operators.pages import rows_between

MONEY = "decimal(18,4)"

# --- fixed values -------------------------------------------------------------
DEFAULT_MAX_ROWS = 200
LOW_STOCK = 10
# ------------------------------------------------------------------------------


def bounded_query(
    spark: SparkSession, sql: str, max_rows: int | None = None, default_max: int = DEFAULT_MAX_ROWS, **views: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """One SELECT / WITH statement -> (rows up to the cap, one row: row_count, truncated).

    One row more than the cap is asked for; whether it exists tells if the answer was cut.
    """
    text = (sql or "").strip()
    if not text:
        raise ValueError("empty statement")
    text = text.removesuffix(";")
    if not text.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT or WITH statements")
    if ";" in text:
        raise ValueError("more than one statement")
    cap = default_max if max_rows is None else min(max(1, max_rows), default_max)
    result = spark.sql(text, **views)
    flag = result.limit(cap + 1).agg(F.count(F.lit(1)).alias("n")).select(
        F.least("n", F.lit(cap)).cast("long").alias("row_count"), (F.col("n") > cap).alias("truncated")
    )
    return result.limit(cap), flag


def orders_by_user(orders: DataFrame, user: int) -> DataFrame:
    return orders.filter(F.col("user_id") == user)


def latest_orders(orders: DataFrame, k: int = 10) -> DataFrame:
    return orders.orderBy(F.desc("order_date"), "id").limit(k)


def items_of_order(items: DataFrame, order: int) -> DataFrame:
    return items.filter(F.col("order_id") == order)


def items_summary(items: DataFrame, order: int) -> DataFrame:
    return items_of_order(items, order).agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("quantity"))


def reviews_of(reviews: DataFrame, product: int | None = None, user: int | None = None) -> DataFrame:
    """Reviews of a user, else of a product, else all."""
    if user is not None:
        return reviews.filter(F.col("user_id") == user)
    return reviews if product is None else reviews.filter(F.col("product_id") == product)


def product_rating(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("avg_rating"))


def user_orders_join(users: DataFrame, orders: DataFrame, user: int | None = None) -> DataFrame:
    chosen = users if user is None else users.filter(F.col("id") == user)
    return chosen.select(F.col("id").alias("user_id"), "username").join(
        orders.select(F.col("id").alias("order_id"), "user_id"), "user_id"
    ).select("username", "order_id")


def item_products_join(items: DataFrame, products: DataFrame, order: int | None = None) -> DataFrame:
    chosen = items if order is None else items_of_order(items, order)
    return chosen.join(products.select(F.col("id").alias("product_id"), "name"), "product_id").select(
        "order_id", "product_id", "name", "quantity"
    )


def orders_per_user(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_orders"))


def heavy_user_product(
    users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Per (user, product): orders, quantity, mean price and the mean rating of the product.

    Items shrink to (user, product) before products and ratings are joined, ratings to one row per
    product before they are.
    """
    owner = orders.select(F.col("id").alias("order_id"), "user_id").join(
        users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    )
    per_pair = (
        items.select("order_id", "product_id", "quantity").join(owner, "order_id")
        .groupBy("user_id", "product_id")
        .agg(F.count("order_id").alias("num_orders"), F.sum("quantity").alias("total_quantity"))
    )
    rated = reviews.groupBy("product_id").agg(F.avg("rating").alias("avg_rating"))
    info = products.select(F.col("id").alias("product_id"), F.col("price").alias("avg_price")).join(rated, "product_id", "left")
    return per_pair.join(info, "product_id")


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts; each is answered from file statistics or a partial count."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def paged_list(
    df: DataFrame, page_no: int, size: int, order: list, user: int | None = None, product: int | None = None
) -> DataFrame:
    """0-based page with the total number of rows; a user filter wins over a product filter."""
    rows = reviews_of(df, product, user)
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows_between(rows, page_no * size, (page_no + 1) * size, order).withColumn("total", total)


def order_total(items: DataFrame, products: DataFrame) -> DataFrame:
    """price * quantity per order; an unknown product or a missing quantity counts 0."""
    priced = items.join(products.select(F.col("id").alias("product_id"), "price"), "product_id", "left")
    line = F.coalesce(F.col("price").cast(MONEY), F.lit(0)) * F.coalesce(F.col("quantity").cast(MONEY), F.lit(0))
    return priced.groupBy("order_id").agg(F.round(F.sum(line), 2).cast("double").alias("total"))


def nested_orders(orders: DataFrame, items: DataFrame, products: DataFrame, item_order: list[str], block: int = 1000) -> DataFrame:
    """Orders with their items and products nested; an order above ``block`` items continues in further rows."""
    full = items.join(products.select(F.col("id").alias("product_id"), "name", "price"), "product_id", "left")
    placed = numbered(full, ["order_id"], item_order, "_rn")
    item = F.struct(*item_order, *[c for c in ("product_id", "name", "price", "quantity") if c not in item_order])
    lists = (
        placed.withColumn("block", F.floor((F.col("_rn") - 1) / block).cast("long"))
        .groupBy("order_id", "block")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    joined = orders.withColumnRenamed("id", "order_id").join(lists, "order_id", "left")
    return joined.withColumn("block", F.coalesce("block", F.lit(0)))


def _mean(c: str, places: int) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)


def user_kpis(users: DataFrame, today: Column) -> DataFrame:
    return users.agg(
        F.count_if(F.col("status") == "active").alias("active_users"),
        F.count_if(F.to_date("created_at") == today).alias("new_users"),
    )


def product_kpis(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count_if(F.col("status") == "active").alias("on_sale"),
        F.count_if(F.col("stock") < LOW_STOCK).alias("low_stock"),
        _mean("price", 2).alias("avg_price"),
    )


def review_kpis(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        _mean("rating", 1).alias("avg_rating"),
        F.count_if(F.col("rating") == 5).alias("five_star"),
        F.count_if(F.col("status") == "pending").alias("pending_reviews"),
    )


def shop_kpis(users: DataFrame, products: DataFrame, reviews: DataFrame, today: Column) -> DataFrame:
    """All panel figures in one row (three one-row aggregates side by side)."""
    key = F.lit(1).alias("_one")
    parts = [user_kpis(users, today), product_kpis(products), review_kpis(reviews)]
    return reduce(lambda a, b: a.join(b, "_one"), [p.select(key, "*") for p in parts]).drop("_one")
