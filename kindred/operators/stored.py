"""Tables and cursors that are kept in a shared folder and survive a run that fails: versions of hash buckets behind a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .upsert import collapse_batch, upsert


class Files:
    """Small files of a folder, by the file system that Spark has for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so a reader has the old text or the new one."""
        new = self.at(f"_{name}.new")
        stream = self.fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(new, self.at(name)):
            self.fs.delete(self.at(name), False)
            if not self.fs.rename(new, self.at(name)):
                raise OSError(f"{name} can't be written to {self.folder}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass(frozen=True)
class StoredTable:
    """SK1, SM7: a table below path, which driver and executors share, in hash buckets of its keys.

    Batches are numbered from 0 on. Each rewrites only the buckets that its keys are in, as a version of that number, and
    then names, in the number's manifest, the version of every bucket. A batch is laid over the manifest before its own, so
    a batch that is tried again, whole or from the middle, gives the same table, and a reader never sees half a batch. One
    batch is written at a time."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def _manifests(self) -> Files:
        return Files(self.spark, f"{self.path}/manifests")

    def _versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version, as of the last manifest (before that number)."""
        files = self._manifests()
        done = [int(x) for x in files.names() if x.isdigit() and (before is None or int(x) < before)]
        return {int(b): v for b, v in json.loads(files.read(str(max(done)))).items()} if done else {}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the last batch that was finished."""
        return self._read(self._versions())

    def merge(self, batch: DataFrame, number: int, mode: str = "merge", order: tuple[str, ...] = ()) -> None:
        """Lays a batch over the table: mode merge overwrites the columns that the batch has, ignore keeps rows that are
        there. order has columns that rise with a row's age from old to new (nulls first): of a key's rows in the batch the
        newest counts, and one that is older than the table's is passed over. Without order any of a key's rows counts, by
        a hash of its columns. Rows with a null key are left out. Columns that the table lacks are ignored."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        given = [c for c in self.schema.fieldNames() if c in batch.columns]
        new = batch.select(*given).dropna(subset=list(self.keys))
        newest: list[Column] = [F.col(c).desc_nulls_last() for c in order] or [F.xxhash64(*given)]
        new = collapse_batch(new, list(self.keys), *newest)
        before = self._versions(number)
        # at most as many rows as there are buckets
        touched = [r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect()]
        if touched:
            old = self._read({b: v for b, v in before.items() if b in touched})
            if order and mode == "merge":
                had = old.select(*self.keys, F.struct(*order).alias("_had"))
                new = new.join(had, list(self.keys), "left").where(F.col("_had").isNull() | (F.struct(*order) >= F.col("_had"))).drop("_had")
            rows = upsert(old, new, self.keys, mode).select(self.schema.fieldNames()).withColumn("bucket", bucket)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
        self._manifests().write(str(number), json.dumps(before | dict.fromkeys(touched, number)))

    def forget(self, keep: int = 2) -> None:
        """Deletes manifests but the last keep ones, and versions that these don't name. What is kept can still be read, and
        batches after the first of them can still be tried again."""
        files = self._manifests()
        done = sorted(int(x) for x in files.names() if x.isdigit())
        named = {v for n in done[-keep:] for v in json.loads(files.read(str(n))).values()}
        for n in done[:-keep]:
            files.delete(str(n))
        versions = Files(self.spark, self.path)
        for name in versions.names():
            if name.startswith("v=") and int(name[2:]) not in named:
                versions.delete(name)


@dataclass(frozen=True)
class Cursor:
    """SC3: how far a table has been read, kept in a file below path."""

    spark: SparkSession
    path: str

    def value(self) -> dict | None:
        text = Files(self.spark, self.path).read("cursor")
        return None if text is None else json.loads(text)

    def run(self, df: DataFrame, work, ts: str = "created_at", key: str = "id", limit: int = 1000, n_recent: int = 0) -> int:
        """Hands the next limit rows after the cursor, in the order of ts and key, to work, with the n_recent newest beside
        them, each row once; then moves the cursor. Returns the number of rows after the cursor.

        The cursor moves over what comes after it only: new rows that are worked early are met again in their turn. Where
        work fails the cursor stays, so the next run has the same rows: work has to bear rows that it has had, as an upsert
        does. Rows of one ts that a limit cuts apart are not lost, as the key is part of the cursor. Rows without ts or key
        are left out. The limits are the operator's purpose; at most that many rows are read from the sorted table."""
        at = self.value()
        df = df.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
        kinds = {f.name: f.dataType for f in df.schema.fields}
        place = F.struct(F.col(ts), F.col(key))
        after = df if at is None else df.where(place > F.struct(F.lit(at["ts"]).cast(kinds[ts]), F.lit(at["key"]).cast(kinds[key])))
        backlog = after.orderBy(ts, key).limit(limit)
        last = backlog.agg(F.count("*").alias("n"), F.max(place).alias("last")).select("n", F.col("last").getField(ts).cast("string").alias("ts"), F.col("last").getField(key).cast("string").alias("key")).first()
        recent = df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n_recent) if n_recent else df.limit(0)
        if last.n or n_recent:
            work(backlog.unionByName(recent).dropDuplicates([key]))
        if last.n:
            Files(self.spark, self.path).write("cursor", json.dumps({"ts": last.ts, "key": last.key}))
        return last.n
