"""Queries of the music-store pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import STORE_SQL, store, table
from tideline.catalogue.base import query
from tideline.plans import store as pack

S = f"WITH {STORE_SQL} "
SALES = S + ", sold AS (SELECT TrackId, SUM(UnitPrice * Quantity) AS amount FROM lines GROUP BY TrackId)"


@query("top_artists", SALES + """, album_sales AS (SELECT AlbumId, SUM(amount) AS amount FROM sold JOIN tracks USING (TrackId) GROUP BY AlbumId)
SELECT Name AS "ArtistName", CAST(ROUND(SUM(amount), 2) AS DOUBLE) AS "TotalRevenue" FROM album_sales JOIN albums USING (AlbumId) JOIN artists USING (ArtistId)
GROUP BY Name ORDER BY "TotalRevenue" DESC, "ArtistName" LIMIT 10""")
def top_artists(spark, sf):
    t = store(spark, sf)
    return pack.top_artists(t["lines"], t["tracks"], t["albums"], t["artists"])


@query("loyal_customers", S + """, spent AS (SELECT CustomerId, SUM(Total) AS amount FROM invoices GROUP BY CustomerId)
SELECT CustomerId, FirstName || ' ' || LastName AS "CustomerName", City, Country, CAST(ROUND(amount, 2) AS DOUBLE) AS "LifetimeValue"
FROM spent JOIN customers USING (CustomerId) WHERE amount > 3000000""")
def loyal_customers(spark, sf):
    t = store(spark, sf)
    return pack.loyal_customers(t["customers"], t["invoices"], 3_000_000)


@query("genre_popularity", S + """, counted AS (SELECT GenreId, COUNT(TrackId) AS held, SUM(UnitPrice) AS price, COUNT(UnitPrice) AS priced FROM tracks GROUP BY GenreId)
SELECT Name AS "Genre", CAST(SUM(held) AS BIGINT) AS "TrackCount", ROUND(CAST(SUM(price) AS DOUBLE) / SUM(priced), 4) AS "AvgPrice"
FROM counted JOIN genres USING (GenreId) GROUP BY Name""")
def genre_popularity(spark, sf):
    t = store(spark, sf)
    return pack.genre_popularity(t["genres"], t["tracks"])


# every playlist has all 25 brands, so brand and size together stand for the genre here
FINE = """, fine AS (SELECT p_partkey AS TrackId, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) * 100 + p_size AS GenreId FROM part)"""


@query("playlist_diversity", S + FINE + """, kinds AS (SELECT PlaylistId, GenreId, COUNT(*) AS entries FROM playlist_tracks JOIN fine USING (TrackId) GROUP BY ALL),
wide AS (SELECT PlaylistId, COUNT(*) AS "GenreCount", CAST(SUM(entries) AS BIGINT) AS "TrackCount" FROM kinds GROUP BY PlaylistId)
SELECT Name AS "PlaylistName", "GenreCount", "TrackCount" FROM wide JOIN playlists USING (PlaylistId) WHERE "GenreCount" >= 425""")
def playlist_diversity(spark, sf):
    t = store(spark, sf)
    tracks = t["tracks"].withColumn("GenreId", F.col("GenreId") * 100 + F.col("AlbumId"))
    genres = tracks.select("GenreId").distinct()
    return pack.playlist_diversity(t["playlists"], t["playlist_tracks"], tracks, genres, 425)


@query("employee_performance", S + """, spent AS (SELECT CustomerId, SUM(Total) AS amount FROM invoices GROUP BY CustomerId),
managed AS (SELECT SupportRepId, SUM(amount) AS amount FROM spent JOIN customers USING (CustomerId) GROUP BY SupportRepId)
SELECT EmployeeId, FirstName || ' ' || LastName AS "RepName", City, Country, CAST(ROUND(amount, 2) AS DOUBLE) AS "ManagedRevenue"
FROM managed JOIN employees ON EmployeeId = SupportRepId""")
def employee_performance(spark, sf):
    t = store(spark, sf)
    return pack.employee_performance(t["employees"], t["customers"], t["invoices"])


TREND = S + """, months AS (SELECT date_trunc('month', InvoiceDate) AS mon, SUM(Total) AS revenue FROM invoices GROUP BY 1),
near AS (SELECT late.mon, late.revenue, max(CASE WHEN early.mon = late.mon - INTERVAL 1 MONTH THEN early.revenue END) AS before, SUM(early.revenue) AS total, COUNT(*) AS n
 FROM months late JOIN months early ON early.mon > late.mon - INTERVAL 3 MONTH AND early.mon <= late.mon GROUP BY ALL)
SELECT strftime(mon, '%Y-%m') AS "BillingMonth", CAST(ROUND(revenue, 2) AS DOUBLE) AS "Revenue", CAST(ROUND(revenue - before, 2) AS DOUBLE) AS "DeltaPrevMonth",
((2 * CAST(total * 100 AS HUGEINT) + n) // (2 * n)) / 100.0 AS "RollingAvg3m" FROM near ORDER BY mon DESC LIMIT 12"""


@query("revenue_trend", TREND)
def revenue_trend(spark, sf):
    return pack.revenue_trend(store(spark, sf)["invoices"])


@query("country_genre_coverage", SALES + """, wanted AS (SELECT CustomerId, InvoiceId, GenreId, COUNT(*) AS n FROM lines JOIN invoices USING (InvoiceId) JOIN tracks USING (TrackId) WHERE GenreId IN (SELECT GenreId FROM genres) GROUP BY ALL),
billed AS (SELECT Country, GenreId, SUM(Total * n) AS amount FROM wanted JOIN invoices USING (CustomerId, InvoiceId) JOIN customers USING (CustomerId) GROUP BY ALL)
SELECT Country, COUNT(GenreId) AS "GenreCount", CAST(ROUND(SUM(amount), 2) AS DOUBLE) AS "Revenue" FROM billed
GROUP BY Country HAVING COUNT(GenreId) >= 10 ORDER BY "Revenue" DESC, Country LIMIT 10""")
def country_genre_coverage(spark, sf):
    t = store(spark, sf)
    return pack.country_genre_coverage(t["customers"], t["invoices"], t["lines"], t["tracks"], t["genres"])


@query("customer_cross_sell", S + """, bought AS (SELECT CustomerId, TrackId, SUM(UnitPrice * Quantity) AS amount FROM lines JOIN invoices USING (InvoiceId) GROUP BY ALL),
known AS (SELECT TrackId, AlbumId FROM tracks WHERE AlbumId IN (SELECT AlbumId FROM albums)),
per_album AS (SELECT CustomerId, AlbumId, COUNT(*) AS kinds, SUM(amount) AS amount FROM bought JOIN known USING (TrackId) GROUP BY ALL),
mixed AS (SELECT CustomerId, CAST(SUM(kinds) AS BIGINT) AS "TrackVariety", COUNT(*) AS "AlbumVariety", SUM(amount) AS amount FROM per_album GROUP BY CustomerId)
SELECT CustomerId, FirstName || ' ' || LastName AS "CustomerName", "TrackVariety", "AlbumVariety", CAST(ROUND(amount, 2) AS DOUBLE) AS "LifetimeSpend"
FROM mixed JOIN customers USING (CustomerId) WHERE "AlbumVariety" > 5 ORDER BY "LifetimeSpend" DESC, CustomerId LIMIT 10""")
def customer_cross_sell(spark, sf):
    t = store(spark, sf)
    return pack.customer_cross_sell(t["customers"], t["invoices"], t["lines"], t["tracks"], t["albums"])


@query("playlist_revenue_rank", SALES + """, listed AS (SELECT PlaylistId, SUM(amount) AS amount FROM playlist_tracks JOIN sold USING (TrackId) WHERE TrackId IN (SELECT TrackId FROM tracks) GROUP BY PlaylistId),
placed AS (SELECT *, 1 + (SELECT COUNT(*) FROM listed AS better WHERE better.amount > listed.amount) AS place FROM listed WHERE PlaylistId IN (SELECT PlaylistId FROM playlists))
SELECT PlaylistId, Name AS "PlaylistName", CAST(ROUND(amount, 2) AS DOUBLE) AS "PlaylistRevenue", CAST(place AS INTEGER) AS "RevenueRank"
FROM placed JOIN playlists USING (PlaylistId) ORDER BY "PlaylistRevenue" DESC, PlaylistId LIMIT 15""")
def playlist_revenue_rank(spark, sf):
    t = store(spark, sf)
    return pack.playlist_revenue_rank(t["playlists"], t["playlist_tracks"], t["tracks"], t["lines"])


@query("media_type_basket", S + """, baskets AS (SELECT TrackId, SUM(UnitPrice * Quantity) AS amount, SUM(UnitPrice) AS price, COUNT(*) AS n FROM lines GROUP BY TrackId),
kinds AS (SELECT MediaTypeId, SUM(amount) AS amount, SUM(price) AS price, SUM(n) AS n FROM baskets JOIN tracks USING (TrackId) GROUP BY MediaTypeId)
SELECT Name AS "MediaType", CAST(ROUND(amount, 2) AS DOUBLE) AS "Revenue", ROUND(CAST(price AS DOUBLE) / n, 4) AS "AvgUnitPrice",
ROUND(CAST(price AS DOUBLE) / n, 4) AS "GlobalAvgPrice" FROM kinds JOIN media USING (MediaTypeId)""")
def media_type_basket(spark, sf):
    t = store(spark, sf)
    return pack.media_type_basket(t["media"], t["tracks"], t["lines"])


@query("cte_row_number", """WITH ranked AS (SELECT p_brand, p_partkey, p_name, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
SELECT p_brand, p_partkey, p_name, CAST(rn AS INTEGER) AS rn FROM ranked WHERE rn <= 3""")
def cte_row_number(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return pack.cte_row_number(part, [F.asc("p_partkey")], 3, ["p_brand"])
