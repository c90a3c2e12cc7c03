"""Pages of an ordered table, however deep.

Sorting a table and dropping what stands before the page brings all rows up to the page's end to one task. An index deals the rows
by range of their order into slices, once; a prefix sum of the slices' sizes tells which one or two of them hold a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tideline.operators.ordered import SLICE, sliced
from tideline.session import stored

#: a page that ends before this many rows is found without an index: each task passes on no more than that
SHALLOW_ROWS = 100_000


@dataclass(frozen=True)
class PageIndex:
    """``rows`` in slices along ``order``, and ``starts``: (_slice, first, n), the position of each slice's first row."""

    rows: DataFrame
    order: list
    starts: DataFrame

    def read(self, lo: int, hi: int) -> DataFrame:
        """Rows at positions lo (from 0) to hi, without hi. Only the slices that hold them are read."""
        held = self.starts.filter((F.col("first") < hi) & (F.col("first") + F.col("n") > lo)).collect()  # few: a page's slices
        before = min((r["first"] for r in held), default=0)
        part = self.rows.filter(F.col(SLICE).isin([r[SLICE] for r in held])).drop(SLICE)
        return part.orderBy(*self.order).offset(max(0, lo - before)).limit(max(0, hi - lo))

    def page(self, page_no: int, size: int) -> DataFrame:
        page_no, size = max(page_no, 1), max(size, 1)
        return self.read((page_no - 1) * size, page_no * size)

    def total(self) -> int:
        return self.starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page_index(df: DataFrame, order: list) -> PageIndex:
    """Index of a table for pages along ``order``, which should be unique for pages not to overlap."""
    s = sliced(df, [], order, foldered=True)
    sizes = s.df.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)  # a row per slice
    starts = stored(sizes.select(SLICE, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "page-starts")
    return PageIndex(s.df, list(order), starts)


def rows_between(df: DataFrame, lo: int, hi: int, order: list) -> DataFrame:
    """Rows at positions lo (from 0) to hi, without hi, of the table sorted by ``order``."""
    if hi <= SHALLOW_ROWS:
        return df.orderBy(*order).offset(lo).limit(max(0, hi - lo))
    return page_index(df, order).read(lo, hi)
