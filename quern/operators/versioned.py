"""Tables of Parquet files that are written as a whole new version, and seen only once that is complete.

A version is a folder of its own; what makes it current is a file in the table's log, which is
created after its files, and of which there can be one only. A job that dies half-way leaves files that no log entry names, and a reader
keeps the version that it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import series
from quern.operators.lineage import cut, drop, shared_folder


class Conflict(Exception):
    """Another writer has made the version that this one was about to make; read again and repeat."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"

    def _log(self) -> tuple:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def entries(self) -> list:
        """(version, folders, batch) of the versions, oldest first; a small file for each."""
        files, folder = self._log()
        if not files.exists(folder):
            return []
        return self.spark.read.schema("version bigint, folders array<string>, batch bigint").json(f"{self.path}/log").orderBy("version").collect()

    def versions(self) -> list[tuple[int, str]]:
        """Numbers and folders of the versions, oldest first."""
        return [(r.version, r.folders[0] if r.folders else "") for r in self.entries()]

    def batch(self) -> int:
        """The last batch of a stream that the table has taken, or -1."""
        return max((r.batch for r in self.entries() if r.batch is not None), default=-1)

    def read(self) -> DataFrame:
        known = self.entries()
        if not known:
            raise ValueError(f"{self.path} has no version yet")
        return self.spark.read.parquet(*known[-1].folders)

    def _commit(self, number: int, folders: list[str], batch: int | None) -> None:
        """Makes a version current, by creating the file of its number; of two writers that try, one gets an error and its rows are not seen."""
        files, folder = self._log()
        jvm = self.spark.sparkContext._jvm
        try:
            out = files.create(jvm.org.apache.hadoop.fs.Path(folder, f"{number:020d}.json"), False)
        except Py4JJavaError as e:
            if "Exist" in str(e.java_exception):
                raise Conflict(f"version {number} of {self.path} is there already") from None
            raise
        try:
            out.write(json.dumps({"version": number, "folders": folders, "batch": batch}).encode())
        finally:
            out.close()

    def replace(self, rows: DataFrame, batch: int | None = None, after: int | None = None) -> VersionedTable:
        """Makes ``rows`` the current version; they may be read from the one before. ``after`` is the version that they were made from, if not the current one."""
        number = (after if after is not None else (self.versions() or [(0, "")])[-1][0]) + 1
        folder = f"{self.path}/v{number}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._commit(number, [folder], batch)
        return self

    def expire(self, keep: int = 1) -> VersionedTable:
        """Deletes the files of all but the newest ``keep`` versions; nobody may be reading them."""
        known = self.entries()
        used = {f for r in known[-keep:] for f in r.folders}
        drop(self.spark, *{f for r in known[:-keep] for f in r.folders if f not in used})
        return self

    def change(self, f: Callable[[DataFrame], DataFrame], batch: int | None = None, tries: int = 5) -> VersionedTable:
        """Makes what ``f`` makes of the current version the next one; once more if another writer was faster. A batch that the table has taken already changes nothing."""
        for left in range(tries - 1, -1, -1):
            known = self.entries()
            if batch is not None and any(r.batch is not None and r.batch >= batch for r in known):
                return self
            try:
                return self.replace(f(self.spark.read.parquet(*known[-1].folders)), batch, known[-1].version)
            except Conflict:
                if not left:
                    raise
        return self

    def upsert_add(self, batch: DataFrame, keys: list[str], n: str) -> VersionedTable:
        """Counters of the batch are added to those of the table."""
        return self.change(lambda old: series.merge_counts(old, batch, keys, n))

    def upsert_last(self, batch: DataFrame, keys: list[str], order: list[str]) -> VersionedTable:
        """Of each key the row that is last in ``order`` stays."""
        return self.change(lambda old: series.latest(old.unionByName(batch), keys, order).select(*old.columns))

    def insert_new(self, batch: DataFrame, keys: list[str]) -> VersionedTable:
        """Rows of the batch whose key the table has not; rows that are there are never changed."""
        return self.change(lambda old: old.unionByName(batch.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns)))

    def replace_keys(self, batch: DataFrame, keys: list[str]) -> VersionedTable:
        """All rows of the keys that the batch holds are replaced by those of the batch."""
        return self.change(lambda old: old.join(batch.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(batch.select(*old.columns)))

    def keep(self, wanted) -> VersionedTable:
        """Rows for which ``wanted`` does not hold go."""
        return self.change(lambda old: old.where(wanted))


class RollUp:
    """Distinct members by signal and bucket, a few signals each run, from where the last run stopped.

    A signal is replaced by overwriting its partition. A row without a bucket stands in
    each, so that a signal that has become empty is replaced as well. The cursor moves on, wraps, and does
    so too when a run fails, so that one bad signal does not hold up the others.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
        self.cursor = VersionedTable(spark, f"{self.path}/cursor")

    def refresh(self, members: DataFrame, signals: list[str], per_run: int = 8, signal: str = "signal", bucket: str = "bucket", member: str = "install_id") -> list[str]:
        """Counts the next ``per_run`` signals over ``members`` and returns their names."""
        start = self.cursor.read().first()["next_signal"] % len(signals) if self.cursor.versions() else 0
        turn = [signals[(start + i) % len(signals)] for i in range(min(per_run, len(signals)))]
        try:
            wanted = members.where(F.col(signal).isin(turn)).select(F.col(signal).alias("signal"), F.col(bucket).alias("bucket"), F.col(member).alias("member"))
            counts = wanted.groupBy("signal", "bucket").agg(F.countDistinct("member").alias("total"))
            marks = self.spark.createDataFrame([(s,) for s in turn], "signal string").select("signal", F.lit(None).cast("string").alias("bucket"), F.lit(0).cast("bigint").alias("total"))
            counts.unionByName(marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signal").parquet(f"{self.path}/rows")
        finally:
            self.cursor.replace(self.spark.createDataFrame([((start + len(turn)) % len(signals),)], "next_signal int").coalesce(1))
        return turn

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").where("bucket is not null").select("signal", "bucket", "total")


class BucketTable(VersionedTable):
    """A table in buckets by the hash of its keys; a change writes the buckets that it touches, and all others stay as they lie.

    A version names a folder for each bucket that has rows.
    """

    def __init__(self, spark: SparkSession, keys: list[str], path: str | None = None, buckets: int = 64):
        super().__init__(spark, path)
        self.keys, self.buckets = keys, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _where(self, known) -> dict[int, str]:
        return {int(f.rsplit("bucket=", 1)[1]): f for f in known.folders} if known else {}

    def read(self, only: list[int] | None = None) -> DataFrame:
        known = self.entries()
        if not known:
            raise ValueError(f"{self.path} has no version yet")
        where = self._where(known[-1])
        folders = [f for b, f in where.items() if only is None or b in only]
        if folders:
            return self.spark.read.parquet(*folders)
        return self.spark.createDataFrame([], self.spark.read.parquet(f"{self.path}/shape").schema)

    def write(self, rows: DataFrame, touched: list[int] | None = None, batch: int | None = None) -> BucketTable:
        """Makes ``rows`` all that the ``touched`` buckets hold (all buckets, if none are named)."""
        known = self.entries()
        number = (known[-1].version if known else 0) + 1
        where = {} if touched is None or not known else {b: f for b, f in self._where(known[-1]).items() if b not in touched}
        folder = f"{self.path}/v{number}-{uuid.uuid4().hex}"
        if not known:
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/shape")
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        files, _ = self._log()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = [str(x.getPath().getName()) for x in files.listStatus(path) if x.isDirectory()]
        self._commit(number, [*where.values(), *(f"{folder}/{n}" for n in found if n.startswith("bucket="))], batch)
        return self

    def replace(self, rows: DataFrame, batch: int | None = None, after: int | None = None) -> BucketTable:
        return self.write(rows, None, batch)


def sync(table: BucketTable, current: DataFrame, key: str, digest: str, step: int = 16) -> DataFrame:
    """Brings an index up to date with ``current``, whose rows hold a key and a digest of their content: (key, action) with insert, update, delete or unchanged.

    Only keys and digests are compared. Buckets without a change are not written, and ``step`` buckets with changes are committed at a time: a run
    that dies goes on where it stopped, since what is committed is unchanged for the next one. Nothing is written if nothing has changed.
    """
    now = current.select(key, F.col(digest).alias("now"))
    if not table.entries():
        table.write(current.limit(0))
    was = table.read().select(key, F.col(digest).alias("was"))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "insert").when(F.col("now") == F.col("was"), "unchanged").otherwise("update")
    actions = cut(was.join(now, key, "full_outer").select(key, action.alias("action")))
    touched = sorted(r[0] for r in actions.where("action != 'unchanged'").select(table.bucket()).distinct().collect())  # at most the number of buckets
    for at in range(0, len(touched), step):
        some = touched[at : at + step]
        changed = actions.where(table.bucket().isin(some) & (F.col("action") != "unchanged")).select(key, "action")
        new = current.join(changed.where("action != 'delete'").select(key), key, "left_semi")
        kept = table.read(some).where(table.bucket().isin(some)).join(changed.select(key), key, "left_anti")
        table.write(kept.select(*current.columns).unionByName(new), some)
    return actions
