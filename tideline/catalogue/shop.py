"""Queries of the web-shop pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import SHOP_SQL, shop, table
from tideline.catalogue.base import query
from tideline.functions.sql_text import _col
from tideline.plans import shop as pack

S = f"WITH {SHOP_SQL} "
RATING = "ROUND(AVG(rating), 6)"


def _r(df, *cols, places=6):
    """Round the given double columns."""
    return df.select(*[F.round(_col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("bounded_query", """SELECT n_name, c AS customers, 10 AS row_count, true AS truncated FROM
(SELECT n_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name LIMIT 10)""")
def bounded_query(spark, sf):
    rows, flag = pack.bounded_query(
        spark,
        "WITH x AS (SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name) SELECT * FROM x ORDER BY n_name;",
        10, c=table(spark, sf, "customer"), n=table(spark, sf, "nation"),
    )
    row = {c: flag.select(c).scalar() for c in flag.columns}
    return rows.withColumn("row_count", row["row_count"].cast("int")).withColumn("truncated", row["truncated"])


@query("orders_by_user", S + "SELECT id, user_id, strftime(order_date, '%Y-%m-%d') AS day FROM shop_orders WHERE user_id = 42")
def orders_by_user(spark, sf):
    rows = pack.orders_by_user(shop(spark, sf)["orders"], 42)
    return rows.select("id", "user_id", F.date_format("order_date", "yyyy-MM-dd").alias("day"))


@query("latest_orders", S + "SELECT id, strftime(order_date, '%Y-%m-%d') AS day FROM shop_orders ORDER BY order_date DESC, id LIMIT 10")
def latest_orders(spark, sf):
    return pack.latest_orders(shop(spark, sf)["orders"]).select("id", F.date_format("order_date", "yyyy-MM-dd").alias("day"))


@query("items_of_order", S + "SELECT product_id, quantity, l_linenumber FROM items WHERE order_id = 7")
def items_of_order(spark, sf):
    return pack.items_of_order(shop(spark, sf)["items"], 7).select("product_id", "quantity", "l_linenumber")


@query("items_summary", S + "SELECT count(*) AS n_items, CAST(sum(quantity) AS BIGINT) AS quantity FROM items WHERE order_id = 7")
def items_summary(spark, sf):
    return pack.items_summary(shop(spark, sf)["items"], 7)


@query("reviews_of_product", S + "SELECT user_id, rating, stamp FROM reviews WHERE product_id = 11")
def reviews_of_product(spark, sf):
    return pack.reviews_of(shop(spark, sf)["reviews"], product=11).select("user_id", "rating", "stamp")


@query("reviews_of_user", S + "SELECT product_id, rating, stamp FROM reviews WHERE user_id = 42")
def reviews_of_user(spark, sf):
    return pack.reviews_of(shop(spark, sf)["reviews"], product=11, user=42).select("product_id", "rating", "stamp")


@query("product_rating", S + f"SELECT product_id, count(*) AS n, {RATING} AS avg_rating FROM reviews GROUP BY product_id")
def product_rating(spark, sf):
    return _r(pack.product_rating(shop(spark, sf)["reviews"]), "avg_rating")


@query("user_orders_join", S + "SELECT u.username, o.id AS order_id FROM users u JOIN shop_orders o ON u.id = o.user_id")
def user_orders_join(spark, sf):
    t = shop(spark, sf)
    return pack.user_orders_join(t["users"], t["orders"])


@query("item_products_join", S + "SELECT i.order_id, i.product_id, p.name, i.quantity FROM items i JOIN products p ON i.product_id = p.id")
def item_products_join(spark, sf):
    t = shop(spark, sf)
    return pack.item_products_join(t["items"], t["products"])


@query("orders_per_user", S + "SELECT user_id, count(*) AS n_orders FROM shop_orders GROUP BY user_id")
def orders_per_user(spark, sf):
    return pack.orders_per_user(shop(spark, sf)["orders"])


@query("heavy_user_product", S + f""", r AS (SELECT product_id, {RATING} AS avg_rating FROM reviews GROUP BY product_id)
SELECT x.user_id, x.product_id, x.num_orders, x.total_quantity, x.avg_price, r.avg_rating FROM (
SELECT u.id AS user_id, p.id AS product_id, count(o.id) AS num_orders, CAST(sum(oi.quantity) AS BIGINT) AS total_quantity,
CAST(avg(p.price) AS DOUBLE) AS avg_price FROM users u JOIN shop_orders o ON u.id = o.user_id JOIN items oi ON o.id = oi.order_id
JOIN products p ON oi.product_id = p.id GROUP BY u.id, p.id) x LEFT JOIN r ON r.product_id = x.product_id""")
def heavy_user_product(spark, sf):
    t = shop(spark, sf)
    out = pack.heavy_user_product(t["users"], t["orders"], t["items"], t["products"], t["reviews"])
    return out.select(
        "user_id", "product_id", "num_orders", "total_quantity", F.col("avg_price").cast("double").alias("avg_price"),
        F.round("avg_rating", 6).alias("avg_rating"),
    )


@query("table_counts", S + """SELECT 'users' AS table_name, count(*) AS n FROM users UNION ALL SELECT 'orders', count(*) FROM shop_orders
UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'reviews', count(*) FROM reviews""")
def table_counts(spark, sf):
    t = shop(spark, sf)
    return pack.table_counts(spark, {n: t[n] for n in ("users", "orders", "items", "reviews")})


@query("paged_list", S + """SELECT product_id, rating, stamp, CAST((SELECT count(*) FROM reviews WHERE user_id = 42) AS BIGINT) AS total
FROM reviews WHERE user_id = 42 ORDER BY product_id, rating, stamp LIMIT 5 OFFSET 10""")
def paged_list(spark, sf):
    rows = pack.paged_list(shop(spark, sf)["reviews"], 2, 5, ["product_id", "rating", "stamp"], user=42)
    return rows.select("product_id", "rating", "stamp", "total")


@query("order_total", S + """SELECT i.order_id, CAST(ROUND(SUM(COALESCE(p.price, 0) * COALESCE(i.quantity, 0)), 2) AS DOUBLE) AS total
FROM items i LEFT JOIN products p ON i.product_id = p.id GROUP BY i.order_id""")
def order_total(spark, sf):
    t = shop(spark, sf)
    return pack.order_total(t["items"], t["products"])


@query("nested_orders", S + """SELECT o.id AS order_id, o.user_id, 0 AS block, count(i.order_id) AS n_items,
COALESCE(string_agg(i.l_linenumber || ':' || i.product_id || ':' || p.name || ':' || i.quantity, '|'
  ORDER BY i.l_linenumber, i.l_extendedprice, i.product_id, i.l_suppkey, i.quantity), '') AS items
FROM shop_orders o LEFT JOIN items i ON i.order_id = o.id LEFT JOIN products p ON p.id = i.product_id GROUP BY o.id, o.user_id""")
def nested_orders(spark, sf):
    t = shop(spark, sf)
    order = ["l_linenumber", "l_extendedprice", "product_id", "l_suppkey", "quantity"]
    nested = pack.nested_orders(t["orders"], t["items"], t["products"], order)
    text = F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"], i["product_id"], i["name"], i["quantity"]))
    return nested.select(
        "order_id", "user_id", F.col("block").cast("int").alias("block"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join(text, "|"), F.lit("")).alias("items"),
    )


@query("shop_kpis", S + """SELECT (SELECT count(*) FROM users WHERE status = 'active') AS active_users,
(SELECT count(*) FROM users WHERE created_at = DATE '1998-01-15') AS new_users,
(SELECT count(*) FROM products WHERE status = 'active') AS on_sale, (SELECT count(*) FROM products WHERE stock < 10) AS low_stock,
(SELECT round(CAST(avg(price) AS DOUBLE), 2) FROM products) AS avg_price, (SELECT round(avg(rating), 1) FROM reviews) AS avg_rating,
(SELECT count(*) FROM reviews WHERE rating = 5) AS five_star, (SELECT count(*) FROM reviews WHERE status = 'pending') AS pending_reviews""")
def shop_kpis(spark, sf):
    t = shop(spark, sf)
    products = t["products"].withColumn("price", F.col("price").cast("double"))
    return pack.shop_kpis(t["users"], products, t["reviews"], F.lit("1998-01-15").cast("date"))
