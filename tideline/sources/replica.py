"""Keyed replicas: tables laid out by key, merged when they are read, compacted bucket by bucket.

A replica is a folder of Parquet files, clustered by its key columns into a number of buckets that never changes and partitioned by
``_at``: one part for the snapshot, one for the changes of each micro-batch, one for each compaction. A manifest per version names
the parts that count and, per bucket, the part its rows start from, so neither readers nor writers list the folder. Rows of one key
lie in one bucket of every part, which Spark knows from the table's layout: reading is a window in each bucket, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

OP, TS, SEQ, ID, AT = "_op", "_ts", "_seq", "_id", "_at"
#: about 1 GB of a table each is a good number
BUCKETS = 64
#: parts with changes of a bucket before it is compacted
COMPACT_AFTER = 8
#: versions that stay readable
KEEP_VERSIONS = 5
_STEPS = 1000  # parts of a batch: its changes, then compactions


@dataclass(frozen=True)
class Manifest:
    """One version: after batch ``batch`` (-1: the snapshot) and ``step`` compactions since."""

    keys: list[str]
    buckets: int
    columns: list[list[str]]
    batch: int = -1
    step: int = 0
    parts: list[int] = field(default_factory=list)
    floors: dict[str, int] = field(default_factory=dict)  # bucket -> first part that counts, where it is not the first of all
    pending: dict[str, int] = field(default_factory=dict)  # bucket -> parts with changes since its last compaction

    @property
    def at(self) -> int:
        return (self.batch + 1) * _STEPS + self.step

    @property
    def file(self) -> str:
        return f"{self.at:018d}.json"


class _Folder:
    """Small files below a path, through the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(st.getPath().getName() for st in self.fs.listStatus(self._path(""))) if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: it is written aside and renamed."""
        aside = self._path(f".{name}-{uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(text.encode())
        out.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(aside, self._path(name)):
            raise OSError(f"cannot write {name} in {self.path}")

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Replica:
    """A version of a replica, open for reading or as the start of the next one."""

    def __init__(self, spark: SparkSession, target: str, manifest: Manifest) -> None:
        self.spark, self.target, self.manifest = spark, target.rstrip("/"), manifest
        self.name = f"tideline_{hashlib.md5(self.target.encode()).hexdigest()}"
        self._registered()

    # opening

    @staticmethod
    def _manifests(spark: SparkSession, target: str) -> _Folder:
        return _Folder(spark, f"{target.rstrip('/')}/_manifest")

    @staticmethod
    def create(spark: SparkSession, target: str, keys: list[str], schema: T.StructType, buckets: int = BUCKETS) -> Replica:
        """A replica without rows, not committed yet."""
        taken = {OP, TS, SEQ, ID, AT} & {f.name for f in schema}
        if taken:
            raise ValueError(f"reserved column names: {sorted(taken)}")
        return Replica(spark, target, Manifest(list(keys), buckets, [[f.name, f.dataType.simpleString()] for f in schema]))

    @staticmethod
    def open(spark: SparkSession, target: str, before: int | None = None) -> Replica:
        """The newest version; with ``before``, the newest that does not hold that batch or later ones."""
        folder = Replica._manifests(spark, target)
        limit = None if before is None else f"{(before + 1) * _STEPS:018d}"
        names = [n for n in folder.names() if n.endswith(".json") and not n.startswith(".") and (limit is None or n < limit)]
        if not names:
            raise ValueError(f"no replica at {target}")
        return Replica(spark, target, Manifest(**json.loads(folder.read(names[-1]))))

    def _registered(self) -> None:
        """The table in this session's catalogue, with the columns and parts of the manifest."""
        m, spark = self.manifest, self.spark
        if not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{n}` {t}" for n, t in [*m.columns, [OP, "string"], [TS, "bigint"], [SEQ, "bigint"], [AT, "bigint"]])
            by = ", ".join(f"`{k}`" for k in m.keys)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet PARTITIONED BY ({AT}) CLUSTERED BY ({by}) INTO {m.buckets} BUCKETS LOCATION '{self.target}/data'")
        known = set(spark.table(self.name).columns)
        more = ", ".join(f"`{n}` {t}" for n, t in m.columns if n not in known)
        if more:
            spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({more})")
        for i in range(0, len(m.parts), 100):
            spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS " + " ".join(f"PARTITION ({AT}={p})" for p in m.parts[i : i + 100]))
        spark.catalog.refreshTable(self.name)

    # reading

    def _bucket(self) -> Column:
        """The bucket Spark puts a row in."""
        return F.pmod(F.hash(*self.manifest.keys), F.lit(self.manifest.buckets))

    def _live(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows that count, of all buckets or only of the files of some."""
        m = self.manifest
        out = self.spark.table(self.name).filter(F.col(AT).isin(m.parts))
        if buckets is not None:
            of_file = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{5,})(?:\.|$)", 1).cast("int")
            out = out.filter(of_file.isin(buckets))
        if m.floors:
            floors = [m.floors.get(str(b), 0) for b in range(m.buckets)]
            if len(set(floors)) == 1:
                return out.filter(F.col(AT) >= floors[0])
            out = out.filter(F.col(AT) >= F.element_at(F.array(*map(F.lit, floors)), self._bucket() + 1))
        return out

    def _last(self, buckets: list[int] | None = None) -> DataFrame:
        """The last record of each key, deletes too."""
        newest = [F.col(c).desc_nulls_last() for c in (TS, SEQ, AT)]
        place = F.row_number().over(W.partitionBy(*self.manifest.keys).orderBy(*newest))
        return self._live(buckets).withColumn("_place", place).filter("_place = 1").drop("_place")

    def read(self) -> DataFrame:
        """Current rows. No shuffle: every bucket is merged where it lies."""
        return self._last().filter(F.col(OP) != "d").select(*[f"`{n}`" for n, _ in self.manifest.columns])

    # writing

    def _insert(self, df: DataFrame, at: int) -> list[int]:
        """Writes a part, without what an earlier attempt left of it; returns the buckets it has rows in."""
        names = [c for c in self.spark.table(self.name).columns if c != AT]  # columns added later stand last
        view, spark = f"part_{uuid4().hex}", df.sparkSession
        self._drop(at)
        df.select(*[f"`{n}`" for n in names]).createOrReplaceTempView(view)
        try:
            spark.sql(f"INSERT INTO TABLE {self.name} PARTITION ({AT}={at}) SELECT * FROM {view}")
        finally:
            spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.name)
        found = self.spark.table(self.name).filter(F.col(AT) == at).select(self._bucket().alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def _drop(self, at: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({AT}={at})")
        _Folder(self.spark, f"{self.target}/data").drop(f"{AT}={at}")

    def _fitted(self, df: DataFrame) -> DataFrame:
        """df with all columns of the table; those it lacks are NULL."""
        have = set(df.columns)
        return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in [*self.manifest.columns, [OP, "string"], [TS, "bigint"], [SEQ, "bigint"]]])

    def _widened(self, df: DataFrame) -> Replica:
        known = {n for n, _ in self.manifest.columns} | {OP, TS, SEQ, ID, AT}
        more = [[f.name, f.dataType.simpleString()] for f in df.schema if f.name not in known]
        return Replica(self.spark, self.target, replace(self.manifest, columns=[*self.manifest.columns, *more])) if more else self

    def load(self, snapshot: DataFrame) -> Replica:
        """The version that holds the snapshot."""
        m = self.manifest
        rows = snapshot.withColumns({OP: F.lit("c"), TS: F.lit(None).cast("bigint"), SEQ: F.lit(None).cast("bigint")})
        self._insert(self._fitted(rows).repartition(m.buckets, *m.keys), m.at)
        return self._commit(replace(m, parts=[m.at]))

    def apply(self, changes: DataFrame, batch: int, compact_after: int = COMPACT_AFTER) -> Replica:
        """The version after a micro-batch of changes (row columns, _op, _ts, _seq; the message's _id is not kept).

        Only the last record of each key is written, into the buckets it belongs to; buckets with ``compact_after`` parts of
        changes are compacted. ``self`` is the version before the batch, so a batch that comes again replaces its own parts.
        """
        r = self._widened(changes)
        m = replace(r.manifest, batch=batch, step=0)
        newest = [F.col(c).desc_nulls_last() for c in (TS, SEQ)]
        dealt = r._fitted(changes).repartition(m.buckets, *m.keys)
        last = dealt.withColumn("_place", F.row_number().over(W.partitionBy(*m.keys).orderBy(*newest))).filter("_place = 1").drop("_place")
        touched = r._insert(last, m.at)
        pending = m.pending | {str(b): m.pending.get(str(b), 0) + 1 for b in touched}
        after = r._commit(replace(m, parts=[*m.parts, m.at], pending=pending))
        due = [int(b) for b, n in pending.items() if n >= compact_after]
        return after.compact(due) if due else after

    def compact(self, buckets: list[int] | None = None) -> Replica:
        """The version in which these buckets (None: all with changes) lie in one part. Other buckets' files are not read.

        Deletes stay as records: a change that arrives later but is older must still lose against them.
        """
        m = self.manifest
        buckets = sorted(map(int, m.pending)) if buckets is None else buckets
        if not buckets:
            return self
        after = replace(m, step=m.step + 1)
        self._insert(self._last(buckets), after.at)
        floors = m.floors | {str(b): after.at for b in buckets}
        pending = {b: n for b, n in m.pending.items() if int(b) not in buckets}
        # parts count as long as a bucket starts from them or has changes in them
        oldest = min([floors.get(str(b), 0) for b in range(m.buckets)])
        parts = [p for p in [*m.parts, after.at] if p >= oldest]
        if not pending:
            parts = [p for p in parts if p in set(floors.values()) or p % _STEPS or p == m.parts[0] and len(floors) < m.buckets]
        return self._commit(replace(after, floors=floors, pending=pending, parts=parts))

    def _commit(self, manifest: Manifest) -> Replica:
        """Readers see the version from now on. Versions beyond KEEP_VERSIONS go, and parts that only they named."""
        folder = self._manifests(self.spark, self.target)
        folder.write(manifest.file, json.dumps(asdict(manifest)))
        names = [n for n in folder.names() if n.endswith(".json") and not n.startswith(".")]
        old, kept = names[:-KEEP_VERSIONS], names[-KEEP_VERSIONS:]
        if old:
            held = {p for n in kept for p in json.loads(folder.read(n))["parts"]}
            gone = {p for n in old for p in json.loads(folder.read(n))["parts"]} - held
            for p in sorted(gone):
                self._drop(p)
            for n in old:
                folder.drop(n)
        return Replica(self.spark, self.target, manifest)
