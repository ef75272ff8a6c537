"""Connected components by alternating star contraction."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that one task of a round holds, about.
EDGES_A_TASK = 200_000


def checkpoint_folder(df: DataFrame) -> str:
    """The checkpoint folder: the session's, or the one named in spark.checkpoint.dir. Where neither is set, a local
    session gets a temporary one; on a cluster that is an error, as executors don't share such a folder."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, held in the checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_folder(df)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written below the checkpoint folder and deleted at the end of a with block, or before by drop.

    Unlike a checkpoint, a written table is computed once and compressed."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = f"{checkpoint_folder(df)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self._delete(self.folder)

    def hold(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(held)] = held, path
        return held

    def drop(self, *held: DataFrame) -> None:
        for df in held:
            self._delete(self.paths.pop(id(df))[1])

    def _delete(self, path: str) -> None:
        delete(self.spark, path)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one (large star), then its smaller neighbours (small
    star), until the edges form stars and stay the same. Both steps are a grouped minimum, which combines before the
    shuffle, and a join. Nulls and loops are ignored. Edges and labels stay distributed, over a number of tasks that follows
    their number; each round is a written table that goes with the next one.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    with Scratch(edges) as scratch:
        e = scratch.hold(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        tasks = max(1, e.count() // EDGES_A_TASK)
        seen = None
        while True:
            near = e.coalesce(tasks)
            both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = _dealt_anew(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
            large = both.where("v > u").join(low, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            linked = large.join(_dealt_anew(low), F.col("u") == F.col("node"))
            small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = scratch.hold(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
            scratch.drop(e)
            e = new
            now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
            if now == seen or not now[0]:
                break
            seen = now
        # a star's centre has a row for each of its leaves: distinct combines them before the shuffle
        return checkpointed(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _dealt_anew(low: DataFrame) -> DataFrame:
    """low under a key that Spark has to deal out again: a join can be split where one node has most of the edges only if
    both sides come straight from an exchange, and low's own comes before its aggregation."""
    return low.select((F.col("u") + F.lit(0)).alias("node"), "m")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet below spark.checkpoint.dir and read again, and where it is."""
    path = f"{checkpoint_folder(df)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what is written there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
