"""N-gram Jaccard join by a token-group matrix.

Texts become sets of hashed word shingles. Sets that may have a partner are put into groups of similar sets; a group stores the
union of its sets' tokens, which bounds the overlap of any set with any member, and only groups whose bound suffices are opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import broadcast_if_small, components, stored
from tideline.llm.shingles import blocks, mix, shingle_hashes

WIDTH, PERCENT = 5, 80
#: percent of a set's smallest hashes looked at first, at least
FIRST = 30
#: texts looked at for tokens so common that they need no search, and in how many of these they are
SAMPLE_TEXTS, SAMPLE_HITS = 2000, 3
#: bytes and sets of a group
GROUP_BYTES, GROUP_SETS = 4_000_000, 2048
#: base of the size steps of a large family's groups
STEP = 1.05
#: tokens that one task counts
TASK_TOKENS = 1_500_000
_COMMON = 2**31 - 1


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        ids, column, row = batch.column(0), batch.column(1), 0
        for first, last, raw, starts in blocks(column):
            for tokens in shingle_hashes(raw, starts, width):
                yield ids[row], tokens
                row += 1
            assert row == last and first <= last


def _class(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = mix(tokens)
        both = np.array([x.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(x) * np.uint64(3))], np.uint64)
        return int(mix(both).view(np.int64)[0])


def shingle_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles, class: equal sets have equal classes (64-bit fingerprints), empty sets none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c = [], []
            for _, t in _sets(iter([batch]), width):
                n.append(len(t))
                c.append(_class(t) if len(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "text_hash", "n_shingles", "class"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, class long")


def _batches(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    parts = [np.concatenate(x) for x in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64) if p.dtype == np.uint64 else p) for p in parts], names=names)


def _tokens(docs: DataFrame, width: int, share: int, common: np.ndarray | None) -> DataFrame:
    """class, token, df of the least `share` percent of each set (class, text); df is 0, the mark of a common token, or -n in one row a set."""
    sent = docs.sparkSession.sparkContext.broadcast(common) if common is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent else np.zeros(0, np.uint64)
        held, size = [], 0
        for c, t in _sets(batches, width):
            n = len(t)
            t = t[: min(n, n * share // 100 + 1)]
            df = np.zeros(len(t) + 1, np.int32)
            df[0] = -n
            if len(known):
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                df[1:][known[at] == t] = _COMMON
            held.append((np.full(len(t) + 1, c.as_py(), np.int64), np.concatenate([np.zeros(1, np.uint64), t]), df))
            size += len(df)
            if size > 200_000:
                yield _batches(held, ["class", "token", "df"])
                held, size = [], 0
        if held:
            yield _batches(held, ["class", "token", "df"])

    return docs.select("class", "text").mapInArrow(run, "class long, token long, df int")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _shared(rows: DataFrame, n_tokens: int, sums: bool) -> DataFrame:
    """Of tokens that several classes have: class, token, df; or with `sums` only the class."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // TASK_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        c, t = _column(table, "class"), _column(table, "token")
        del parts, table
        order = np.lexsort((c, t))
        c, t = c[order], t[order]
        once = np.ones(len(t), bool)
        once[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])  # a repeated row has its class's tokens twice
        c, t = c[once], t[once]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        df = np.repeat(np.diff(np.append(begin, len(t))), np.diff(np.append(begin, len(t))))
        c, t, df = c[df > 1], t[df > 1], df[df > 1].astype(np.int32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(c)], names=["class"])
        else:
            for a in range(0, len(t), 200_000):
                yield _batches([(c[a : a + 200_000], t[a : a + 200_000], df[a : a + 200_000])], ["class", "token", "df"])

    rows = rows.where("df = 0").select("class", "token").repartition(tasks, "token")
    return rows.mapInArrow(run, "class long" if sums else "class long, token long, df int")


def _whole_sets(rows: DataFrame, n_tokens: int, percent: int) -> DataFrame:
    """class, n, tokens (packed), lead: of sets that have enough shared tokens for a partner; lead is what any partner must meet.

    lead holds the shared ones among the first n - ceil(percent n) + 1 tokens, rarest first.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // TASK_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        c, t, df = _column(table, "class"), _column(table, "token"), _column(table, "df")
        del parts, table
        order = np.lexsort((t, df, c))
        c, t, df = c[order], t[order], df[order]
        begin = np.append(np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])), len(c)).tolist()
        out: list[list] = [[], [], [], []]
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            n = -int(df[a])  # the row -n comes first
            while a < b and df[a] < 0:
                a += 1
            mine = t[a:b]
            if n <= 0 or len(mine) * 100 < percent * n:
                continue
            lead = n - -(-percent * n // 100) + 1 - (n - len(mine))
            lead_tokens, mine = mine[:lead], np.unique(mine)
            for o, v in zip(out, (int(c[a]), n, mine.tobytes(), lead_tokens.tolist()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], names=["class", "n", "tokens", "lead"])

    return rows.repartition(tasks, "class").mapInArrow(run, "class long, n long, tokens binary, lead array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every left with every right set (tokens distinct in a set), in blocks of the token-set matrix."""
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def matrix(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        row, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        ok = part[at] == flat
        m = np.zeros((len(sets), len(part)), np.float32)
        m[row[ok], at[ok]] = 1
        return m

    for a in range(0, len(vocabulary), 4096):
        part = vocabulary[a : a + 4096]
        out += matrix(left, part) @ matrix(right, part).T
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def open_group(n_left: np.ndarray, left: list[np.ndarray], n_right: np.ndarray, right: list[np.ndarray], percent: int, same: bool) -> list[tuple[int, int]]:
    """Links (left row, right row) that span all links between the two lists: a forest, not all pairs. same: the lists are one."""
    rows, cols = np.arange(len(left)), np.arange(len(right))
    if not same:
        # the bound: overlap with the union of the other side's tokens
        union = np.unique(np.concatenate([right[j] for j in cols]))
        rows = rows[[len(np.intersect1d(left[i], union, assume_unique=True)) * 100 >= percent * n_left[i] for i in rows]]
        if not len(rows):
            return []
        union = np.unique(np.concatenate([left[i] for i in rows]))
        cols = cols[[len(np.intersect1d(right[j], union, assume_unique=True)) * 100 >= percent * n_right[j] for j in cols]]
        if not len(cols):
            return []
    both = overlaps([left[i] for i in rows], [right[j] for j in cols])
    hit = 100 * both >= percent * (n_left[rows][:, None] + n_right[cols][None, :] - both)
    if same:
        hit &= rows[:, None] < cols[None, :]
    parent = list(range(len(left) + (0 if same else len(right))))
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
        i, j = int(rows[i]), int(cols[j])
        a, b = _find(parent, i), _find(parent, j if same else len(left) + j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _unpack(values: list) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.int64) for v in values]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _reach(percent: int) -> int:
    """How many size steps two sets that link may lie apart: neither has more than 100 / percent of the other's size."""
    return math.floor(math.log(100 / percent) / math.log(STEP) + 1e-9) + 1


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links between sets (class, n, tokens, lead) that span all links.

    Any two linked sets meet in a lead token, so families of sets connected by lead tokens hold all partners. A family is one group,
    or, beyond GROUP_BYTES or GROUP_SETS, several by size and hash; groups are opened by themselves, and pairs of a family's groups of fitting
    sizes after the bound.
    """
    lead = sets.select("class", F.explode("lead").alias("token"))
    first = lead.groupBy("token").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b <> most")
    family = stored(components(lead.join(first, "token").select(F.col("class").alias("a"), "b").distinct()).withColumnRenamed("node", "class"), "families")
    sets = sets.drop("lead").join(family, "class").withColumn("step", F.floor(F.log("n") / F.log(F.lit(STEP))).cast("int"))
    sets = stored(sets, "sets")
    weight = lambda n, b: F.ceil(F.greatest(F.count("*") / n, F.sum(F.length("tokens")) / b)).cast("int")
    big = sets.groupBy("component").agg(weight(GROUP_SETS, GROUP_BYTES).alias("g")).where("g > 1").select("component")
    cut = stored(sets.select("component", "step", "tokens").join(big, "component").groupBy("component", "step").agg(weight(GROUP_SETS, GROUP_BYTES).alias("cuts")), "groups")
    sets = sets.join(cut, ["component", "step"], "left")
    sets = sets.withColumn("step", F.when(F.col("cuts").isNull(), 0).otherwise(F.col("step"))).withColumn("part", F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), "cuts")).cast("int"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = None, ([], [], [])
        found: list[tuple[int, int]] = []

        def close() -> None:
            c, n, t = held
            if len(c) > 1:
                found.extend((c[i], c[j]) for i, j in open_group(np.array(n), t, np.array(n), t, percent, True))
            for x in held:
                x.clear()

        for batch in batches:
            d = batch.to_pydict()
            for k1, k2, k3, c, n, t in zip(d["component"], d["step"], d["part"], d["class"], d["n"], _unpack(d["tokens"]), strict=True):
                if keys != (k1, k2, k3):
                    close()
                    keys = (k1, k2, k3)
                for x, v in zip(held, (c, n, t), strict=True):
                    x.append(v)
            if found:
                yield _edges(found)
                found = []
        close()
        if found:
            yield _edges(found)

    rows = sets.select("component", "step", "part", "class", "n", "tokens")
    own = rows.repartition("component", "step", "part").sortWithinPartitions("component", "step", "part").mapInArrow(inside, "a long, b long")
    if not cut.take(1):
        return own

    # groups of a large family, one row each, bounded by the size of a group
    packed = stored(rows.join(cut.select("component").distinct(), "component").groupBy("component", "step", "part").agg(F.collect_list(F.struct("class", "n", "tokens")).alias("members")), "groups")
    other = packed.select(F.col("component").alias("c2"), F.col("step").alias("s2"), F.col("part").alias("p2"), F.col("members").alias("others"))
    pairs = packed.join(other, F.col("component") == F.col("c2")).where(
        ((F.col("step") < F.col("s2")) | ((F.col("step") == F.col("s2")) & (F.col("part") < F.col("p2")))) & (F.col("s2") <= F.col("step") + _reach(percent))
    )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                lists = [([x["class"] for x in s], np.array([x["n"] for x in s]), _unpack([x["tokens"] for x in s])) for s in (one, two)]
                (c1, n1, t1), (c2, n2, t2) = lists
                found = [(c1[i], c2[j]) for i, j in open_group(n1, t1, n2, t2, percent, False)]
                if found:
                    yield _edges(found)

    pairs = pairs.select("members", "others", F.xxhash64("component", "step", "part", "s2", "p2").alias("k")).repartition("k").select("members", "others")
    return own.union(pairs.mapInArrow(across, "a long, b long"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row of docs.

    Two texts link when 100 x common shingles >= percent x shingles of both; component_id is the least doc_id that links reach. Texts
    without words link with nothing. Rows of one doc_id with other texts are documents of their own; repeated rows link. A null
    doc_id takes part but names no component unless all are null. No cap: every pair of different sets that may link is compared,
    and sets that equal another are represented by one of them.
    """
    return _grouped(docs, doc_id, text, width, percent).select("doc_id", "text_hash", "n_shingles", "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The rows of jaccard_components and g, which tells components apart even where doc_ids repeat."""
    known = stored(shingle_classes(docs, doc_id, text, width), "classes")
    real = known.where("class IS NOT NULL")
    name = F.struct("doc_id", "text_hash")
    chosen = real.groupBy("class").agg(F.min(name).alias("one"), F.max(name).alias("last"), F.max("n_shingles").alias("n"))
    spare = stored(real.join(chosen.where("one <> last"), "class").where(~name.eqNullSafe(F.col("one"))).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct(), "spare")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    own = lambda other: texts["doc_id"].eqNullSafe(other["d"]) & (texts["text_hash"] == other["h"])
    one_each = texts.join(broadcast_if_small(spare, 40), own(spare), "left_anti").withColumn("class", F.xxhash64("doc_id", "text_hash"))
    # a document is named by its row here; rows are put back to classes at the end
    total, n_docs = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()

    part = one_each.where(F.pmod("text_hash", F.lit(max(1, n_docs // SAMPLE_TEXTS))) == 0)
    seen = _tokens(part, width, 100, None).where("df = 0").groupBy("token").agg(F.countDistinct("class").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    common = np.sort(np.array([r[0] for r in seen.select("token").collect()], np.int64).view(np.uint64))  # bounded by the sample

    look = max(FIRST, 100 - percent)
    some = _tokens(one_each, width, look, common)
    counted = _shared(some, total * look // 100, True)
    marks = some.where("df <> 0").groupBy("class").agg(F.sum(F.when(F.col("df") == _COMMON, 1).otherwise(0)).alias("n"), F.max(F.when(F.col("df") < 0, -F.col("df"))).alias("size"))
    counted = counted.groupBy("class").agg(F.count("*").alias("more"))
    # A set looks at `look` percent + 1 tokens, of which a partner lacks at most 100 - percent percent of the set. Of two partners,
    # the one that looks less far shares all the rest with the other's first tokens, and it has percent of the other's size at least.
    least = F.expr(f"({look - 100 + percent} * ((size * {percent} + 99) div 100)) div 100 + 1")
    suspects = marks.join(counted, "class", "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= least).select(F.col("class").alias("c"))
    suspects = stored(suspects, "suspects")

    rows = stored(_tokens(one_each.join(broadcast_if_small(suspects, 24), F.col("class") == F.col("c"), "left_semi"), width, 100, common), "tokens")
    n_tokens = rows.count()
    sets = stored(_whole_sets(_shared(rows, n_tokens, False).union(rows.where("df <> 0")), n_tokens, percent), "sets")
    links = components(set_links(sets, percent))

    members = known.withColumn("row", F.xxhash64("doc_id", "text_hash"))
    by_row = members.join(links, members["row"] == links["node"]).where("class IS NOT NULL").groupBy("class").agg(F.min("component").alias("component"))
    members = members.drop("row").join(by_row, "class", "left")
    # classes without links stand for themselves, empty texts for their row
    group = F.when(F.col("class").isNull(), F.struct(F.lit(2).alias("k"), F.lit(0).cast("long").alias("v"))).when(F.col("component").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("component").alias("v"))).otherwise(F.struct(F.lit(0).alias("k"), F.col("class").alias("v")))
    members = stored(members.withColumn("g", group), "members")
    least = members.where("g.k < 2").groupBy("g").agg(F.min("doc_id").alias("least"))
    out = members.join(least, "g", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "g", F.when(F.col("g.k") == 2, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that of the least doc_id; documents without words all stay. Columns stay."""
    found = stored(_grouped(docs, doc_id, text, width, percent), "found")
    # of rows that repeat the least doc_id the least text hash stays, of fully repeated rows one
    head = found.where("n_shingles > 0").groupBy("g").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.count("*").alias("n"))
    keys = found.where("n_shingles > 0").join(head.where("n > 1"), "g")
    gone = stored(keys.where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("x"))).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct(), "gone")
    twice = stored(found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")), "twice")

    def same(x: DataFrame):
        return docs[doc_id].eqNullSafe(x["__d"]) & (F.xxhash64(docs[text]) == x["__h"])

    rest = docs.join(broadcast_if_small(gone, 40), same(gone), "left_anti")
    if not twice.take(1):
        return rest
    again = rest.join(broadcast_if_small(twice, 40), F.col(doc_id).eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__h")), "left")
    single = again.where("__h IS NULL").drop("__d", "__h")
    firsts = [F.first(c).alias(c) for c in docs.columns]
    one = again.where("__h IS NOT NULL").groupBy("__d", "__h").agg(*firsts).select(*docs.columns)
    return single.unionByName(one)
