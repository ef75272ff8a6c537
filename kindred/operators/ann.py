"""An inverted-file index of vectors: cells around centroids, written as a table partitioned by cell, of which a query reads a few.

Centroids come from a bounded sample (spherical k-means); every vector goes to the cell of its nearest centroid. How many
cells a query has to read is calibrated on the sample: as many as hold the wanted share of the sample's true neighbours."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of what centroids are fitted on: vectors and numbers in them. Cells at most, and vectors a cell to aim at.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
MOST_CELLS, CELL_ROWS = 4096, 2048
#: Queries of the sample, and neighbours of each, on which probes are calibrated, and the share of them to be found.
CALIBRATED, NEIGHBOURS, SHARE = 512, 10, 0.97
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1)[:, None]


def _usable(flat: np.ndarray, cut: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vectors have that length, finite numbers and a direction, and these vectors at length one."""
    rows = np.flatnonzero(np.diff(cut) == dim)
    x = _unit(flat[cut[rows][:, None] + np.arange(dim)])
    good = np.isfinite(x).all(1)
    return rows[good], x[good]


def fit_cells(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors: k-means by cosine from a random start. A cell that runs empty gets the vector farthest from
    its centroid."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        near = x @ centroids.T
        own = near.argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        total[empty] = x[np.argsort(near[np.arange(len(x)), own], kind="stable")[: len(empty)]]
        norm = np.linalg.norm(total, axis=1)
        centroids = np.where(norm[:, None] > 0, total / np.where(norm, norm, 1)[:, None], centroids)
    return centroids


def calibrate(x: np.ndarray, centroids: np.ndarray, share: float = SHARE) -> int:
    """How many cells, nearest first, hold that share of the sample vectors' nearest neighbours in the sample."""
    asked = np.arange(min(CALIBRATED, len(x)))
    near = x[asked] @ x.T
    near[asked, asked] = -np.inf
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cell_of = (x @ centroids.T).argmax(1)
    place = np.empty((len(asked), len(centroids)), np.int64)
    order = np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable")
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), 1)
    needed = np.sort(np.take_along_axis(place, cell_of[best], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)])


@dataclass(frozen=True)
class CellIndex:
    """An index below path. centroids and probes are what it was built with; they are small and travel with every task."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int
    schema: T.StructType

    def vectors(self) -> DataFrame:
        """item_id, vector, what else items had, and cell, by which the table is partitioned."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{self.path}/vectors")

    def _near(self, df: DataFrame, most: int) -> DataFrame:
        """df's rows once for each of the most cells nearest to their vector."""
        centroids = self.spark.sparkContext.broadcast(self.centroids)
        at, names = df.columns.index("vector"), [*df.columns, "cell"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centroids.value
            for batch in batches:
                lists = batch.column(at)
                rows, x = _usable(np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64), lists.offsets.to_numpy(), c.shape[1])
                near = x @ c.T
                n = min(most, len(c))
                cell = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
                out = batch.take(pa.array(np.repeat(rows, n)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.ravel().astype(np.int32))], names)

        schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
        return df.where("vector is not null").mapInArrow(assign, schema)

    def add(self, items: DataFrame) -> None:
        """Puts items (item_id, vector and the index's other columns) into their cells. Vectors that are null, zero, of
        another length or not finite are left out, as they have no neighbours. A cell is written by as many tasks as its
        new vectors ask for, so a cell that holds a third of them is no single task's work."""
        placed = self._near(items.withColumn("vector", F.col("vector").cast("array<double>")), 1)
        sizes = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / (16 * CELL_ROWS)).cast("int").alias("files"))
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("file", F.pmod(F.xxhash64("item_id"), F.col("files")))
        dealt.repartition("cell", "file").drop("file", "files").select(*self.schema.fieldNames(), "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def pairs(self, queries: DataFrame, probes: int | None = None, group: bool = False) -> DataFrame:
        """key, vector, cell, p, q, side and, if asked for, group: queries in the cells they probe and the items there. Where
        a cell has more than CELL_ROWS of either side, its rows are dealt into tiles, p of queries and q of items, and each
        tile of one side meets every tile of the other. Only cells that are asked for are read."""
        own = ["query_id", "vector", *(["query_group"] if group else [])]
        asked = self._near(queries.select(*own).withColumn("vector", F.col("vector").cast("array<double>")), probes or self.probes)
        # at most MOST_CELLS rows reach the driver, so that the scan leaves other cells' files alone
        tiles = {r.cell: -(-r["count"] // CELL_ROWS) for r in asked.groupBy("cell").count().collect()}
        items = self.vectors().where(F.col("cell").isin(*tiles))
        held = {r.cell: -(-r["count"] // CELL_ROWS) for r in items.groupBy("cell").count().collect()}
        both = F.broadcast(self.spark.createDataFrame([(c, tiles[c], n) for c, n in held.items()], "cell int, n_p int, n_q int"))

        def dealt(df: DataFrame, side: int, name: str, mine: str, other: str) -> DataFrame:
            more = [F.col(name.replace("_id", "_group")).cast("string").alias("group")] if group else []
            place, every = F.pmod(F.xxhash64(name), F.col(f"n_{mine}")).alias(mine), F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)
            return df.join(both, "cell").select(F.col(name).cast("string").alias("key"), "vector", "cell", place.cast("int").alias(mine), every, F.lit(side).alias("side"), *more)

        left, right = dealt(asked, 0, "query_id", "p", "q"), dealt(items, 1, "item_id", "q", "p")
        return left.unionByName(right)


def build_index(items: DataFrame, path: str, cells: int | None = None, share: float = SHARE) -> CellIndex:
    """Writes an index of items (item_id, vector and any other columns) below path, which driver and executors share.

    Centroids and probes come from at most SAMPLE_ROWS vectors of at most SAMPLE_NUMBERS numbers, in the order of a hash of
    item_id, which reach the driver; all vectors are indexed. The default number of cells is the square root of the rows',
    at most MOST_CELLS and a quarter of the sample. Vectors of the sample's most frequent length count. Items without any
    usable vector give an index that finds nothing."""
    spark = items.sparkSession
    n = items.where("vector is not null").count()
    sized = items.where("vector is not null").select(F.xxhash64("item_id").alias("h"), F.col("vector").cast("array<double>").alias("vector"))
    longest = sized.agg(F.max(F.size("vector"))).first()[0] or 1
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, longest)))
    sample = sized.orderBy("h").limit(rows).select("vector").toArrow().column("vector").combine_chunks()
    lists = sample if isinstance(sample, pa.Array) else (sample.chunk(0) if sample.num_chunks else pa.array([], pa.list_(pa.float64())))
    cut = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int64)
    length, seen = np.unique(np.diff(cut), return_counts=True)
    dim = int(length[seen.argmax()]) if len(length) else 1
    _, x = _usable(np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64), cut, dim) if len(lists) and dim else (None, np.empty((0, 1)))
    count = max(1, min(cells or int(np.sqrt(n)), MOST_CELLS, max(1, len(x) // 4)))
    centroids = fit_cells(x, count) if len(x) else np.zeros((1, max(dim, 1)))
    probes = calibrate(x, centroids, share)
    schema = items.withColumn("vector", F.col("vector").cast("array<double>")).schema
    rows = [(i, [float(v) for v in c], probes, schema.json()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, vector array<double>, probes int, schema string").coalesce(1).write.parquet(f"{path}/centroids")
    index = CellIndex(spark, path, centroids, probes, schema)
    index.add(items)
    return index


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """The index that is below path."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return CellIndex(spark, path, np.array([r.vector for r in rows]), rows[0].probes, T.StructType.fromJson(json.loads(rows[0].schema)))
