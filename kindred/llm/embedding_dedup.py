"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components.

Vectors of one label meet in a bucket if the signs of their products with a table's hyperplanes agree. The tables' number
follows from the least cosine and the wanted recall, the planes' from the number of vectors, so that a bucket stays small
as the input grows. Pairs of a bucket are compared in double precision, tile by tile, and never written out: each vector's
links are counted at the first table where its pair meets, and a tile hands on a spanning forest of its links. Equal
vectors are one class with a count from the start. A bucket that holds a third of all vectors is thus many small tasks of
bounded memory, or, where its vectors are equal, a single row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import Scratch, checkpointed, components

TILE = 1024


def lsh_shape(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Planes a table and tables, for n vectors: each pair at that cosine is found with that probability at least."""
    planes = min(60, max(6, math.ceil(math.log2(max(n, 2) / 64))))
    agree = (1 - math.acos(cosine) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, as links between vectors of one label.

    Two vectors link when both have the same label, not null, and their cosine is at least the limit in double precision.
    A vector that is null, empty or zero, or holds null or non-finite components, links with nothing, as do vectors of
    different lengths; so does one without a label. n_links counts the other vectors linked directly, component_id is the
    smallest vec_id reachable, kept tells whether that is the vector itself. Rows that share a vec_id are one vector, the
    least of them by label and components. Rows without vec_id are left out. Other columns are ignored; an empty table
    gives an empty result.
    """
    with Scratch(vectors) as scratch:
        return checkpointed(_labelled(vectors, cosine, recall, seed, scratch))


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the smallest member of each one's set, after the sets of a and b have been joined pair by pair."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _labelled(vectors: DataFrame, cosine: float, recall: float, seed: int, scratch: Scratch) -> DataFrame:
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x")).alias("v")).where("vec_id is not null")
    every = scratch.hold(every.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.x"))
    good = "coalesce(label is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(x, e -> e <> 0), false)"
    usable = every.where(good)
    classes = scratch.hold(usable.groupBy("label", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    planes, tables = lsh_shape(classes.count(), cosine, recall)

    def sign(batches):
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            xs = batch.column(2)
            size = np.diff(xs.offsets.to_numpy())
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = xs.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                if dim not in normals:
                    normals[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((dim, planes * tables))
                bits = (x @ normals[dim] > 0).reshape(len(rows), tables, planes)
                code = bits @ (np.int64(1) << np.arange(planes, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(rows)) for c in ("vec_id", "label", "copies")), pa.array(list(x)), pa.array(list(code)), pa.array(np.full(len(rows), dim, np.int32))], ["vec_id", "label", "copies", "x", "codes", "dim"]
                )

    signed = scratch.hold(classes.select("vec_id", "label", "x", "copies").mapInArrow(sign, "vec_id long, label string, copies long, x array<double>, codes array<long>, dim int"))
    placed = signed.select("vec_id", "label", "dim", F.posexplode("codes").alias("turn", "code"))
    sizes = placed.groupBy("label", "dim", "turn", "code").agg(F.count("*").alias("held")).where("held > 1")
    tiled = placed.join(sizes, ["label", "dim", "turn", "code"]).withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    tiled = tiled.select("vec_id", "label", "dim", "turn", "code", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile").join(signed.select("vec_id", "copies", "x", "codes"), "vec_id")

    def compare(table: pa.Table) -> pa.Table:
        turn, p, q = (table.column(c)[0].as_py() for c in ("turn", "p", "q"))
        ids, tile, copies = (table.column(c).to_numpy() for c in ("vec_id", "tile", "copies"))
        x = np.concatenate([c.flatten().to_numpy() for c in table.column("x").chunks]).reshape(len(ids), -1)
        codes = np.concatenate([c.flatten().to_numpy() for c in table.column("codes").chunks]).reshape(len(ids), -1)[:, :turn]
        order = np.argsort(ids)
        ids, tile, copies, x, codes = ids[order], tile[order], copies[order], x[order], codes[order]
        left, right = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            a, b = np.nonzero(x[rows] @ x[right].T >= cosine)
            a, b = rows[a], right[b]
            keep = a < b if p == q else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            if turn and len(a):
                first = ~(codes[a] == codes[b]).any(1)  # else they have met at an earlier table
                a, b = a[first], b[first]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = merged(root, a, b)
        forest = [(ids[i], ids[root[i]]) for i in np.flatnonzero(root != np.arange(len(ids)))]
        some = np.flatnonzero(links)
        out = [(int(ids[i]), int(links[i]), None) for i in some] + [(int(i), 0, int(j)) for i, j in forest]
        v, n, to = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"vec_id": pa.array(v, pa.int64()), "links": pa.array(n, pa.int64()), "to": pa.array(to, pa.int64())})

    met = scratch.hold(tiled.groupBy("label", "dim", "turn", "code", "p", "q").applyInArrow(compare, "vec_id long, links long, to long"))
    counted = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    grouped = components(met.where("to is not null"), "vec_id", "to").withColumnRenamed("node", "vec_id")
    # members of a class link with one another and share its links; a class of many is split by Spark as both sides are tables
    done = classes.join(counted, "vec_id", "left").join(grouped, "vec_id", "left")
    done = scratch.hold(done.select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    linked = usable.join(done, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = every.where(f"not {good}").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
