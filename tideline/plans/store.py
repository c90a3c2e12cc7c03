"""Music-store query pack.

Amounts are summed as decimals, so results do not depend on the order of addition; figures leave as
doubles rounded to cents. Facts are joined to dimensions only where a column of the dimension is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators.ordered import top_n_per_group
from tideline.operators.relational import calendar_prev_delta, calendar_range_avg, month_index

MONEY = "decimal(18,4)"


def cents(c: Column, places: int = 2) -> Column:
    return F.round(c, places).cast("double")


def amount() -> Column:
    return (F.col("UnitPrice").cast(MONEY) * F.col("Quantity")).cast("decimal(18,4)")


def top_artists(lines: DataFrame, tracks: DataFrame, albums: DataFrame, artists: DataFrame, k: int = 10) -> DataFrame:
    """Revenue per artist name. Lines are added up per track before they meet the dimensions."""
    per_track = lines.groupBy("TrackId").agg(F.sum(amount()).alias("rev"))
    joined = (
        per_track.join(tracks.select("TrackId", "AlbumId"), "TrackId")
        .join(albums.select("AlbumId", "ArtistId"), "AlbumId")
        .join(artists.select("ArtistId", F.col("Name").alias("ArtistName")), "ArtistId")
    )
    out = joined.groupBy("ArtistName").agg(cents(F.sum("rev")).alias("TotalRevenue"))
    return out.orderBy(F.desc("TotalRevenue"), "ArtistName").limit(k)


def loyal_customers(customers: DataFrame, invoices: DataFrame, minimum: float = 100) -> DataFrame:
    spent = invoices.groupBy("CustomerId").agg(F.sum(F.col("Total").cast(MONEY)).alias("v")).filter(F.col("v") > minimum)
    rows = spent.join(customers, "CustomerId")
    return rows.select(
        "CustomerId",
        F.concat("FirstName", F.lit(" "), "LastName").alias("CustomerName"),
        "City", "Country",
        cents(F.col("v")).alias("LifetimeValue"),
    ).orderBy(F.desc("LifetimeValue"), "CustomerId")


def genre_popularity(genres: DataFrame, tracks: DataFrame) -> DataFrame:
    per_genre = tracks.groupBy("GenreId").agg(
        F.count("TrackId").alias("n"),
        F.sum(F.col("UnitPrice").cast(MONEY)).alias("s"),
        F.count("UnitPrice").alias("priced"),
    )
    rows = per_genre.join(genres.select("GenreId", F.col("Name").alias("Genre")), "GenreId")
    return (
        rows.groupBy("Genre")
        .agg(F.sum("n").alias("TrackCount"), F.round(F.sum("s").cast("double") / F.sum("priced"), 4).alias("AvgPrice"))
        .orderBy(F.desc("TrackCount"), "Genre")
    )


def playlist_diversity(playlists: DataFrame, pt: DataFrame, tracks: DataFrame, genres: DataFrame, minimum: int = 5) -> DataFrame:
    """Grouped by playlist id and name, so equal names stay separate rows."""
    known = tracks.select("TrackId", "GenreId").join(genres.select("GenreId"), "GenreId", "left_semi")
    per_list = (
        pt.join(known, "TrackId")
        .groupBy("PlaylistId")
        .agg(F.count_distinct("GenreId").alias("GenreCount"), F.count("TrackId").alias("TrackCount"))
        .filter(F.col("GenreCount") >= minimum)
    )
    rows = per_list.join(playlists.select("PlaylistId", F.col("Name").alias("PlaylistName")), "PlaylistId")
    ordered = rows.orderBy(F.desc("GenreCount"), F.desc("TrackCount"), "PlaylistName", "PlaylistId")
    return ordered.select("PlaylistName", "GenreCount", "TrackCount")


def employee_performance(employees: DataFrame, customers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices are added up per customer first; the two joins then carry one row per customer."""
    per_customer = invoices.groupBy("CustomerId").agg(F.sum(F.col("Total").cast(MONEY)).alias("v"))
    per_rep = (
        per_customer.join(customers.select("CustomerId", "SupportRepId"), "CustomerId")
        .groupBy(F.col("SupportRepId").alias("EmployeeId"))
        .agg(F.sum("v").alias("v"))
    )
    return (
        per_rep.join(employees, "EmployeeId")
        .select(
            "EmployeeId", F.concat("FirstName", F.lit(" "), "LastName").alias("RepName"), "City", "Country",
            cents(F.col("v")).alias("ManagedRevenue"),
        )
        .orderBy(F.desc("ManagedRevenue"), "EmployeeId")
    )


def revenue_trend(invoices: DataFrame, months: int = 12) -> DataFrame:
    """Monthly revenue, change to the calendar month before and mean of the months present in three.

    The windows run over one row per calendar month, never over invoices.
    """
    monthly = invoices.groupBy(
        month_index(F.col("InvoiceDate")).alias("m"), F.date_format("InvoiceDate", "yyyy-MM").alias("BillingMonth")
    ).agg(F.sum(F.col("Total").cast(MONEY)).alias("rev"))
    both = calendar_prev_delta(calendar_range_avg(monthly, "m", "rev"), "m", "rev")
    return both.orderBy(F.desc("m")).limit(months).select(
        "BillingMonth",
        cents(F.col("rev")).alias("Revenue"),
        cents(F.col("delta_prev")).alias("DeltaPrevMonth"),
        cents(F.col("rolling_avg")).alias("RollingAvg3m"),
    )


def country_genre_coverage(
    customers: DataFrame, invoices: DataFrame, lines: DataFrame, tracks: DataFrame, genres: DataFrame,
    minimum: int = 10, k: int = 10,
) -> DataFrame:
    """The invoice total counts once per line, as the query is written. Lines shrink to (invoice, genre) first."""
    known = tracks.select("TrackId", "GenreId").join(genres.select("GenreId"), "GenreId", "left_semi")
    per_invoice = (
        lines.select("InvoiceId", "TrackId").join(known, "TrackId").groupBy("InvoiceId", "GenreId").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = per_invoice.join(invoices.select("InvoiceId", "CustomerId", "Total"), "InvoiceId").join(
        customers.select("CustomerId", "Country"), "CustomerId"
    )
    total = F.sum(F.col("Total").cast(MONEY) * F.col("n"))
    out = rows.groupBy("Country", "GenreId").agg(total.alias("v")).groupBy("Country").agg(
        F.count("GenreId").alias("GenreCount"), cents(F.sum("v")).alias("Revenue")
    )
    return out.filter(F.col("GenreCount") >= minimum).orderBy(F.desc("Revenue"), "Country").limit(k)


def customer_cross_sell(
    customers: DataFrame, invoices: DataFrame, lines: DataFrame, tracks: DataFrame, albums: DataFrame,
    minimum: int = 5, k: int = 10,
) -> DataFrame:
    """Two distinct counts from one (customer, track) table: a track has one album."""
    owned = tracks.select("TrackId", "AlbumId").join(albums.select("AlbumId"), "AlbumId", "left_semi")
    per_track = (
        lines.join(invoices.select("InvoiceId", "CustomerId"), "InvoiceId")
        .groupBy("CustomerId", "TrackId")
        .agg(F.sum(amount()).alias("rev"))
        .join(owned, "TrackId")
    )
    per_album = per_track.groupBy("CustomerId", "AlbumId").agg(F.count(F.lit(1)).alias("t"), F.sum("rev").alias("rev"))
    out = (
        per_album.groupBy("CustomerId")
        .agg(F.sum("t").alias("TrackVariety"), F.count(F.lit(1)).alias("AlbumVariety"), cents(F.sum("rev")).alias("LifetimeSpend"))
        .filter(F.col("AlbumVariety") > minimum)
        .join(customers.select("CustomerId", F.concat("FirstName", F.lit(" "), "LastName").alias("CustomerName")), "CustomerId")
    )
    return (
        out.orderBy(F.desc("LifetimeSpend"), "CustomerId").limit(k)
        .select("CustomerId", "CustomerName", "TrackVariety", "AlbumVariety", "LifetimeSpend")
    )


def playlist_revenue_rank(playlists: DataFrame, pt: DataFrame, tracks: DataFrame, lines: DataFrame, k: int = 15) -> DataFrame:
    """RANK() over unrounded revenue, first k by rounded revenue.

    Playlists below the k-th rounded revenue cannot change the ranks above them. Spark keeps the first k
    (with ties) of every task before one task sees them, and the rank runs over what is left.
    """
    per_track = lines.groupBy("TrackId").agg(F.sum(amount()).alias("rev"))
    earning = per_track.join(tracks.select("TrackId"), "TrackId", "left_semi")
    totals = pt.join(earning, "TrackId").groupBy("PlaylistId").agg(F.sum("rev").alias("rev"))
    rounded = totals.withColumn("PlaylistRevenue", F.round("rev", 2))
    head = rounded.withColumn("_place", F.rank().over(W.orderBy(F.desc("PlaylistRevenue")))).filter(F.col("_place") <= k)
    ranked = head.withColumn("RevenueRank", F.rank().over(W.orderBy(F.desc("rev"))))
    named = ranked.join(playlists.select("PlaylistId", F.col("Name").alias("PlaylistName")), "PlaylistId")
    return (
        named.orderBy(F.desc("PlaylistRevenue"), "PlaylistId").limit(k)
        .select("PlaylistId", "PlaylistName", F.col("PlaylistRevenue").cast("double").alias("PlaylistRevenue"), "RevenueRank")
    )


def media_type_basket(media: DataFrame, tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """Per media type id; the correlated mean runs over the same lines and keys, so one aggregate gives both."""
    price = F.col("UnitPrice").cast(MONEY)
    per_track = lines.groupBy("TrackId").agg(
        F.sum(amount()).alias("rev"), F.sum(price).alias("p"), F.count("UnitPrice").alias("n")
    )
    per_type = (
        per_track.join(tracks.select("TrackId", "MediaTypeId"), "TrackId")
        .groupBy("MediaTypeId")
        .agg(F.sum("rev").alias("rev"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    mean = F.round(F.col("p").cast("double") / F.col("n"), 4)
    rows = per_type.join(media.select("MediaTypeId", F.col("Name").alias("MediaType")), "MediaTypeId")
    return rows.orderBy(F.desc("rev"), "MediaTypeId").select(
        "MediaType", cents(F.col("rev")).alias("Revenue"), mean.alias("AvgUnitPrice"), mean.alias("GlobalAvgPrice")
    )


def cte_row_number(df: DataFrame, order: list[Column], n: int = 3, part: list[str] = ()) -> DataFrame:
    """``WITH ranked AS (.. ROW_NUMBER() ..) .. WHERE rn <= n``."""
    if part:
        return top_n_per_group(df, list(part), order, n)
    return df.orderBy(*order).limit(n).withColumn("rn", F.row_number().over(W.orderBy(*order)))
