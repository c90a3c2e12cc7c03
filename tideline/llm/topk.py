"""Exact top-k by histogram selection: count scores, close in on each query's kth value, then filter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stored

#: rows of one strip of the grid, and the parts of a score range in one round
QUERY_ROWS, CANDIDATE_ROWS, BINS = 4096, 4096, 256
_AT_ONCE = 256  # queries scored at once: 256 x 4096 scores of 8 bytes


def quantized(df: DataFrame, id_col: str, vector: str, scale: int = 64) -> DataFrame:
    """id, vec: floor(scale * x) of every component as long. Vectors that are null or hold null or non-finite parts go."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: bad(x.cast("double"))), F.lit(True)) & F.col(id_col).isNotNull()
    return df.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def _matrix(column: pa.ChunkedArray, exact_floats: bool, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors count as padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), dtype=np.float64 if exact_floats else object)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat if exact_floats else [int(x) for x in flat]
    return out


def _scores(queries: pa.Table, candidates: pa.Table, exact_floats: bool, width: int):
    """Blocks of queries: their rows, and integer scores with the query's own rows masked out."""
    q, c = _matrix(queries["vec"], exact_floats, width), _matrix(candidates["vec"], exact_floats, width)
    qid, cid = queries["query_id"].to_numpy(), candidates["id"].to_numpy()
    for a in range(0, len(qid), _AT_ONCE):
        s = q[a : a + _AT_ONCE] @ c.T
        yield slice(a, a + _AT_ONCE), s.astype(np.int64), qid[a : a + _AT_ONCE, None] != cid[None, :]


def histogram_topk(queries: DataFrame, candidates: DataFrame, k: int, bins: int = BINS, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates by integer inner product.

    queries and candidates hold (id long, vec array<long>). Candidates of a query are all rows with another id; ties go to the
    smaller id; fewer than k candidates give all. Several query rows of one id count as the least of them, repeated candidates
    count each. A component that one vector lacks counts as 0. Scores must fit a long.

    Queries and candidates are cut into strips, and a task gets one strip of each, so memory is bounded and nothing is broadcast.
    Every round scores all pairs, counts each query's scores over `bins` parts of the range that holds its kth score and narrows
    that range; a task sends no part that its own k best rule out. The last pass sends only scores at or above the kth, and of
    those equal to it the k smallest ids of a strip.
    """
    queries = stored(queries.groupBy("id").agg(F.min("vec").alias("vec")).select(F.col("id").alias("query_id"), "vec"), "topk")
    candidates = stored(candidates.select("id", "vec").withColumn("row", F.monotonically_increasing_id()), "topk")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    nq, mq, wq = queries.agg(F.count("*"), F.max(square), F.max(F.size("vec"))).first()
    nc, mc, wc = candidates.agg(F.count("*"), F.max(square), F.max(F.size("vec"))).first()
    bound = int(math.sqrt((mq or 0) * (mc or 0)) * 1.000001) + 2
    width, floats = max(wq or 0, wc or 0, 1), bound < 2**53
    down, across = max(1, -(-nq // query_rows)), max(1, -(-nc // candidate_rows))
    cells = lambda df, n, cell: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("cell", cell).drop("other", "strip", "row")
    placed = queries.withColumn("strip", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int"))
    right = cells(candidates.withColumn("strip", F.pmod("row", F.lit(across)).cast("int")), down, F.col("other") * across + F.col("strip")).groupBy("cell")
    rounds = max(1, math.ceil(math.log(2 * bound + 2) / math.log(bins) - 1e-12))
    state = queries.select("query_id", F.lit(-bound - 1).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))

    def left(state: DataFrame):
        return cells(placed.join(state, "query_id"), across, F.col("strip") * across + F.col("other")).groupBy("cell")

    for r in range(rounds):
        step = bins ** (rounds - 1 - r)

        def count(q: pa.Table, c: pa.Table) -> pa.Table:  # runs within this round
            ids, at, n = [], [], []
            low, need, qid = q["low"].to_numpy(), q["need"].to_numpy(), q["query_id"].to_numpy()
            if q.num_rows and c.num_rows:
                for rows, s, valid in _scores(q, c, floats, width):
                    part = (s - low[rows, None]) // step
                    valid &= (part >= 0) & (part < bins)
                    m = len(s)
                    grid = np.bincount((part + np.arange(m)[:, None] * bins)[valid], minlength=m * bins).reshape(m, bins)
                    above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid  # rows of this strip in higher parts
                    i, j = np.nonzero((grid > 0) & (above < need[rows, None]))
                    ids.append(qid[rows][i])
                    at.append(j)
                    n.append(grid[i, j])
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            return pa.table({"query_id": cat(ids), "part": cat(at), "n": cat(n)})

        counts = left(state).cogroup(right).applyInArrow(count, "query_id long, part long, n long").groupBy("query_id", "part").agg(F.sum("n").alias("n"))
        down_to = Window.partitionBy("query_id").orderBy(F.desc("part"))
        found = counts.join(state, "query_id").withColumn("upto", F.sum("n").over(down_to))
        # the part with the kth score; with fewer scores than that, the lowest part there is
        found = found.withColumn("hit", F.col("upto") >= F.col("need")).groupBy("query_id").agg(
            F.max(F.when(F.col("hit"), F.struct("part", "upto", "n", "need", "low"))).alias("x"), F.min(F.struct("part", "upto", "n", "need", "low")).alias("y")
        )
        x = F.coalesce(F.col("x"), F.col("y"))
        state = stored(found.select("query_id", (x["low"] + x["part"] * step).alias("low"), (x["need"] - x["upto"] + x["n"]).alias("need")), "topk")

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        low, qid, cid = q["low"].to_numpy(), q["query_id"].to_numpy(), c["id"].to_numpy()
        order = np.argsort(cid, kind="stable")
        c, cid = c.take(order), cid[order]
        if q.num_rows and c.num_rows:
            for rows, s, valid in _scores(q, c, floats, width):
                tie = valid & (s == low[rows, None])
                keep = (valid & (s > low[rows, None])) | (tie & (np.cumsum(tie, axis=1) <= k))
                i, j = np.nonzero(keep)
                for o, v in zip(out, (qid[rows][i], cid[j], s[i, j]), strict=True):
                    o.append(v)
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    rows = left(state).cogroup(right).applyInArrow(best, "query_id long, vec_id long, score long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
