"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import broadcast_if_small, stored

#: share of a host's pages from which a line is boilerplate, and the least pages that must hold it
RATIO, MIN_PAGES = 0.1, 5


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = True) -> DataFrame:
    """host, lines (hashes): what at least `ratio` of a host's pages and at least `min_pages` of them hold, blank lines apart.

    A page counts once for a line. A host's pages of the same lines, blank ones and outer blanks apart, are one page in both
    counts, unless copies_once is false. Counts are combined before the shuffle. A host has at most (lines a page) / ratio such lines,
    whatever its size, so its list is bounded.
    """
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("ls"))
    pages = pages.select("host", F.transform(F.filter("ls", lambda x: F.trim(x) != ""), _line_key).alias("keys"))
    if copies_once:
        pages = pages.withColumn("page", F.xxhash64("keys")).groupBy("host", "page").agg(F.first("keys").alias("keys"))  # combined before the shuffle
    keys = F.array_distinct("keys")
    # the page itself is counted through a null line, so the text is read once
    counted = pages.select("host", F.explode(F.concat(keys, F.array(F.lit(None).cast("long")))).alias("line"))
    counted = stored(counted.groupBy("host", "line").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("line").isNull()), "lines")
    totals = counted.where("line IS NULL").select("host", F.col("n").alias("pages"))
    often = counted.where("line IS NOT NULL").join(totals, "host").where(F.col("n") >= F.col("pages") * ratio)
    return often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = True) -> DataFrame:
    """docs with `text` freed of its host's boilerplate lines, and n_lines, n_dropped. Every row stays, others columns too.

    Lines end at newline and are compared without outer blanks; kept lines stay as they are and are joined by newline. A null text
    stays null (0 lines), a page without host is left alone, an empty text is one blank line. A page of which all lines go has
    an empty text. Copies of a page are counted as one page, unless copies_once is false, and all lose the same lines. Columns named n_lines or n_dropped are replaced.
    """
    bad = stored(boilerplate(docs, text, host, ratio, min_pages, copies_once), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size("lines") * 8 + 64), F.lit(0))).first()[0]
    bad = bad.select(F.col("host").alias("__host"), F.col("lines").alias("__bad"))
    bad = broadcast_if_small(bad, 0 if size <= 32_000_000 else 2**40)
    rows = docs.join(bad, docs[host] == F.col("__host"), "left").withColumn("__lines", F.explode(F.array(F.split(text, "\n"))))
    kept = F.filter("__lines", lambda x: ~F.array_contains(F.col("__bad"), _line_key(x)) | (F.trim(x) == ""))
    rows = rows.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(kept))
    n = lambda c: F.coalesce(F.when(F.col(text).isNull(), 0).otherwise(F.size(c)), F.lit(0)).cast("long")
    rows = rows.withColumn("n_lines", n("__lines")).withColumn("n_dropped", n("__lines") - n("__kept"))
    rows = rows.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text)))
    return rows.drop("__host", "__bad", "__lines", "__kept")
