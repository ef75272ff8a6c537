"""Nearest neighbours by cosine, and perceptual-hash neighbours."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ann import CellIndex
from .upsert import checkpointed

#: Rows of the smallest blocks, and numbers of the largest: the fewer blocks, the less often a vector is sent.
BLOCK, NUMBERS = 2048, 1 << 20
#: Cosines that a task holds at once.
TILE = 1 << 22


def _blocks(df: DataFrame) -> int:
    """Blocks of a side: up to eight of 2048 rows or more, so that small inputs too are several tasks, and then as many as hold
    at most NUMBERS numbers each."""
    n, dim = df.agg(F.count("vector"), F.max(F.size("vector"))).first()
    return max(1, min(n // BLOCK, 8), n * (dim or 0) // NUMBERS)


def _block_pairs(queries: DataFrame, items: DataFrame, blocks: int | None, group: bool = False) -> DataFrame:
    """key, vector, p, q, side and, if asked for, group of both sides, each row once for every block of the other side."""
    n_q, n_i = (blocks, blocks) if blocks else (_blocks(queries), _blocks(items))
    floats = all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (queries, items))
    numbers = "array<float>" if floats else "array<double>"

    def dealt(df: DataFrame, side: int, name: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        place, every = F.pmod(F.xxhash64(name), F.lit(n_own)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        more = [F.col(name.replace("_id", "_group")).cast("string").alias("group")] if group else []
        return df.where("vector is not null").select(F.col(name).cast("string").alias("key"), F.col("vector").cast(numbers).alias("vector"), place, every, F.lit(side).alias("side"), *more)

    # a pair of blocks is few bytes and much work, so partitions must not be put together by their bytes
    return dealt(queries, 0, "query_id", "p", n_q, "q", n_i).unionByName(dealt(items, 1, "item_id", "q", n_i, "p", n_q)).repartition(min(n_q * n_i, 4096), "p", "q")


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all vectors, one after the other, and where each vector begins, with the end. Nulls in vectors are
    not numbers."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    cut = lists.offsets.to_numpy()
    return np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64), cut


def _cosines(table: pa.Table, names: tuple[str, ...]):
    """For vectors of one length, some queries at a time: the named columns of these queries and of the items, and the matrix
    of their cosines; where there is none, it holds -inf."""
    table = table.combine_chunks()
    columns = [np.array(table.column(c).to_pylist(), object) for c in names]
    side, (flat, cut) = table.column("side").to_numpy(), _vectors(table.column("vector"))
    size = np.diff(cut)
    for dim in np.unique(size):
        a, b = (np.flatnonzero((side == s) & (size == dim)) for s in (0, 1))
        if len(a) and len(b) and dim:
            x, y = (flat[cut[rows][:, None] + np.arange(dim)] for rows in (a, b))
            with np.errstate(invalid="ignore", divide="ignore"):
                x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
            step, other = max(1, TILE // len(b)), [c[b] for c in columns]
            for at in range(0, len(a), step):
                with np.errstate(invalid="ignore"):
                    s = x[at : at + step] @ y.T
                s[np.isnan(s)] = -np.inf
                yield [c[a[at : at + step]] for c in columns], other, s


def _nearest(s: np.ndarray, least: float, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest numbers of each row, of least at least, in order; ties, to nine places, by rank of the
    column."""
    keep = (s >= least) & np.isfinite(s)
    many = np.flatnonzero(np.count_nonzero(keep, axis=1) > 4 * k)
    if len(many):
        # what rounds to the number at the edge stays in
        edge = np.partition(s[many], -k, axis=1)[:, -k] - 2e-9
        keep[many] &= s[many] >= edge[:, None]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((rank[cols], -np.round(s[rows, cols], 9), rows))
    rows, cols = rows[order], cols[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], cols[first]


def _ranks(names: np.ndarray) -> np.ndarray:
    out = np.empty(len(names), np.int64)
    out[np.argsort(names, kind="stable")] = np.arange(len(names))
    return out


def _met(queries: DataFrame, items: DataFrame | CellIndex, blocks: int | None, probes: int | None, group: bool = False) -> GroupedData:
    """What queries are compared with: all items, block by block, or those of an index's cells."""
    if isinstance(items, CellIndex):
        return items.pairs(queries, probes, group).groupBy("cell", "p", "q")
    return _block_pairs(queries, items, blocks, group).groupBy("p", "q")


def knn_groups(queries: DataFrame, items: DataFrame, k: int = 10, least: float = 0.0, blocks: int | None = None, probes: int | None = None) -> DataFrame:
    """WN1 by groups: (query_group, item_group, query_id, item_id, score): for each group of queries its k best other groups
    of items, a pair of groups by its best pair of vectors, ties by item_group; of equal pairs the largest ids.

    queries: query_id, vector, query_group; items: item_id, vector, item_group, or an index of such items, as in knn_join. A
    task hands on at most k groups for each group of its queries, which the best k of all it compares are among.
    """

    def product(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for (asked, own), (names, other), s in _cosines(table, ("key", "group")):
            own_names, own_at = np.unique(own.astype(str), return_inverse=True)
            other_names, other_at = np.unique(other.astype(str), return_inverse=True)
            s = np.where(s >= least, s, -np.inf)
            rows, cols = np.argsort(own_at, kind="stable"), np.argsort(other_at, kind="stable")
            row_cut, col_cut = np.searchsorted(own_at[rows], np.arange(len(own_names) + 1)), np.searchsorted(other_at[cols], np.arange(len(other_names) + 1))
            best = np.maximum.reduceat(np.maximum.reduceat(s[np.ix_(rows, cols)], col_cut[:-1], axis=1), row_cut[:-1], axis=0)
            # a group is no neighbour of itself
            same = np.searchsorted(other_names, own_names)
            own_too = np.flatnonzero(other_names[np.minimum(same, len(other_names) - 1)] == own_names)
            best[own_too, same[own_too]] = -np.inf
            for g, h in zip(*_nearest(best, least, k, np.arange(len(other_names))), strict=True):
                i, j = rows[row_cut[g] : row_cut[g + 1]], cols[col_cut[h] : col_cut[h + 1]]
                x, y = np.nonzero(s[np.ix_(i, j)] >= best[g, h] - 2e-9)
                _, a, b, score = max((round(float(s[p, q]), 9), asked[p], names[q], float(s[p, q])) for p, q in zip(i[x], j[y], strict=True))
                out.append((own_names[g], other_names[h], a, b, score))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_group", "item_group", "query_id", "item_id", "score"), columns, [pa.string()] * 4 + [pa.float64()], strict=True)})

    met = _met(queries, items, blocks, probes, True).applyInArrow(product, "query_group string, item_group string, query_id string, item_id string, score double")
    one = met.groupBy("query_group", "item_group").agg(F.max(F.struct(F.round("score", 9).alias("s"), "query_id", "item_id", "score")).alias("b"))
    order = W.partitionBy("query_group").orderBy(F.col("b.s").desc(), "item_group")
    return one.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query_group", "item_group", "b.query_id", "b.item_id", "b.score")


def knn_join(queries: DataFrame, items: DataFrame | CellIndex, k: int = 10, least: float = 0.0, blocks: int | None = None, probes: int | None = None) -> DataFrame:
    """WN1: (query_id, item_id, score): each query's k best items of at least that cosine, ties by item_id.

    queries: query_id, vector; items: item_id, vector, or an index of such items; ids are unique. Vectors that are null, zero
    or of another length match nothing. Over a table the result is exact: both sides are dealt into blocks, and each pair of
    blocks is one task of a matrix product that keeps k items a query; a task's memory is two blocks and a tile of cosines.
    Equal vectors are compared once, by the smallest of their ids, and are held in the checkpoint folder. Over an index only the items of the
    probes cells nearest to a query are compared with it (by default as many as the index was calibrated for), so some
    neighbours can be missing; scores are exact."""

    def product(table: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for (asked,), (names,), s in _cosines(table, ("key",)):
            rows, cols = _nearest(s, least, k, _ranks(names))
            out.append((asked[rows], names[cols], s[rows, cols]))
        f, t, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ((), (), ())
        return pa.table({"query_id": pa.array(f, pa.string()), "item_id": pa.array(t, pa.string()), "score": pa.array(s, pa.float64())})

    def best(met: DataFrame, by: str) -> DataFrame:
        order = W.partitionBy(by).orderBy(F.round("score", 9).desc(), "item_id")
        return met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")

    def compared(met: GroupedData) -> DataFrame:
        return best(met.applyInArrow(product, "query_id string, item_id string, score double"), "query_id")

    if isinstance(items, CellIndex):
        return compared(_met(queries, items, blocks, probes))
    asked, given = _classes(queries, "query_id"), _classes(items, "item_id")
    one = [df.where("member = first").select(F.col("first").alias(name), "vector") for df, name in ((asked, "query_id"), (given, "item_id"))]
    near = compared(_met(*one, blocks, probes))
    # a class gives its k smallest ids at most
    members = given.withColumn("_n", F.row_number().over(W.partitionBy("first").orderBy("member"))).where(F.col("_n") <= k)
    near = best(near.join(members.select(F.col("first").alias("item_id"), "member"), "item_id").select("query_id", F.col("member").alias("item_id"), "score"), "query_id")
    return asked.select(F.col("first").alias("_q"), F.col("member").alias("query_id")).join(near.withColumnRenamed("query_id", "_q"), "_q").select("query_id", "item_id", "score")


def _classes(df: DataFrame, name: str) -> DataFrame:
    """(first, member, vector): rows with a vector, and the smallest id of those that have the same."""
    rows = df.where("vector is not null").select(F.col(name).cast("string").alias("member"), "vector")
    return checkpointed(rows.withColumn("first", F.min("member").over(W.partitionBy("vector"))))


def phash_pairs(photos: DataFrame, most: int = 8) -> DataFrame:
    """JN21: (a, b, distance) of photos whose 64-bit hashes differ in at most so many bits.

    Of the hash's bands of 22, 21 and 21 bits, one has at most a third of the flipped bits. Both sides of the join have each
    band with up to half of these bits flipped, so a key is shared by few hashes. A pair is taken in the first band that is
    near enough, at the key where the first side has flipped the lower half of its bits, so it comes out once. Photos of one
    hash are one side of the join and are told apart afterwards. Keys are many times the rows that they are made from, whose
    size Spark goes by, so without the hint it may gather all keys on the driver for a broadcast."""
    half = [F.conv(F.substring("phash", at, 8), 16, 10).cast("long") for at in (1, 9)]
    good = photos.where(F.col("phash").rlike("^[0-9a-f]{16}$")).select("id", F.shiftleft(half[0], 32).bitwiseOR(half[1]).alias("h"))
    near = most // 3
    cuts = ((0, 22), (22, 21), (43, 21))

    def part(x: Column, band: int) -> Column:
        return F.shiftrightunsigned(x, cuts[band][0]).bitwiseAND(F.lit((1 << cuts[band][1]) - 1))

    def keys(band: int) -> Column:
        flips = [sum(1 << b for b in bits) for n in range((near + 1) // 2 + 1) for bits in combinations(range(cuts[band][1]), n)]
        return F.transform(F.array(*(F.lit(m | band << 22).cast("long") for m in flips)), lambda m: part(F.col("hash"), band).bitwiseXOR(m))

    def at_key(x: Column) -> Column:
        return F.element_at(F.array(*(part(x, i) for i in range(3))), band + 1)

    # a key holds its band above the band's bits
    keyed = good.select(F.col("h").alias("hash")).distinct().select("hash", F.explode(F.flatten(F.array(*map(keys, range(3))))).alias("key"))
    met = keyed.withColumnRenamed("hash", "h").hint("merge").join(keyed.withColumnRenamed("hash", "g"), "key").where("h <= g")
    band = F.shiftright("key", 22).cast("int")
    differ = F.col("h").bitwiseXOR(F.col("g"))
    here, flipped = at_key(differ), at_key(F.col("h")).bitwiseXOR(F.col("key").bitwiseAND((1 << 22) - 1))
    lower, rest = F.lit(0).cast("long"), here
    for n in range(1, near // 2 + 1):
        lowest = rest.bitwiseAND(-rest)
        lower, rest = F.when(F.bit_count(here) >= 2 * n, lower.bitwiseOR(lowest)).otherwise(lower), rest.bitwiseXOR(lowest)
    first = F.bit_count(here) <= near
    for i in range(2):
        first = first & ((band <= i) | (F.bit_count(part(differ, i)) > near))
    met = met.where((F.bit_count(differ) <= most) & first & (flipped == lower)).select("h", "g", F.bit_count(differ).alias("distance"))
    a, b = good.select(F.col("id").alias("a"), "h"), good.select(F.col("id").alias("b"), F.col("h").alias("g"))
    out = met.join(a, "h").join(b, "g").where("h <> g or a < b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
