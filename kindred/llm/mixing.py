"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot n of the schedule is the point frac((n + 1) / golden ratio), mapped through the sources' cumulative shares: any
stretch of the schedule has the sources near their shares. A slot's rank among its source's slots names the block of that
source that it takes. Blocks are equal stretches of tokens of the source's documents in shuffled order, begun again once
they are used up. Ranks beyond a source's target are not taken, and the few ranks that a source still lacks when the
points end close the schedule, so each source meets its target to the word.

Running sums (documents in shuffled order, ranks of slots) go chunk by chunk, so a source with a third of all rows is no
task of its own. Rows of one source, doc_id and size are one row with a count until their places are known, so rows without
doc_id, or with a shared one, are no more rows of a chunk than they have sizes. Sources themselves are few beside documents: their shares come from windows over one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import Scratch, checkpointed

BLOCK_WORDS = 512
CELLS = 4096
SLOTS_A_CHUNK = ROWS_A_CHUNK = 16384
#: Equal rows that one row of a task is spread into.
COPIES_A_ROW = 4096
GOLDEN = 0.6180339887498949
WORD = "[^\\x20\\x09-\\x0D]+"


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, name: str, tail: list[Column] | None = None) -> DataFrame:
    """df with name: the sum of value over the rows of its keys before it, by chunk and then order."""
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(sums, [*keys, chunk]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_before")


def spread(folded: DataFrame, rows: int) -> DataFrame:
    """A row for each of the copies of a row of folded, start being the copy's own. rows: how many there are in all. Rows of
    many copies are cut and dealt out anew before they are spread."""
    few, many = folded.where(F.col("copies") <= COPIES_A_ROW).withColumn("from", F.lit(0).cast("long")), folded.where(F.col("copies") > COPIES_A_ROW)
    many = many.withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES_A_ROW}L)"))).repartition(max(1, rows >> 20), "place", "start", "from")
    copy = F.explode(F.expr(f"sequence(from, least(copies, from + {COPIES_A_ROW}) - 1)"))
    return few.unionByName(many).withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("from", "copy", "copies", "words")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """place, source, source_size and target of every source of sizes (source, size).

    Sources in code point order, null last, take the weights in turn and share that multiple of all sizes; a target stops
    at most times its source's size and the excess is shared again by weight. Sources that stop are those of the least
    size a weight, so one pass in that order finds the common level. Its windows hold one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights)) + 1)).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    earlier, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    by = by.select(
        "*",
        F.row_number().over(order).alias("turn"),
        ((share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))).alias("level"),
    )
    by = by.withColumn("last", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(whole))
    return by.select("place", "source", "source_size", F.when(F.col("turn") < F.col("last.turn"), F.col("cap")).otherwise(F.col("last.level") * F.col("weight")).alias("target"))


def schedule(sources: DataFrame, total: int, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, place (of the source) and rank, for every block that the mix takes. sources: place, quota."""
    spark = sources.sparkSession
    grown = sources.where("quota > 0").withColumn("need", F.ceil(F.col("quota") / block))
    upto = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    shares = grown.withColumn("hi", F.sum("quota").over(upto) / F.sum("quota").over(W.partitionBy())).withColumn("lo", F.lag("hi", 1, 0.0).over(W.orderBy("place")))
    cells = shares.select("place", "need", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    n = -(-total // block)
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"((id + 1) * {GOLDEN}D) % 1.0D").alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    dealt = points.join(cells, "cell").where("lo <= x and x < hi").select("slot", "place", "need", F.floor(F.col("slot") / SLOTS_A_CHUNK).alias("chunk"), F.lit(1).alias("one"))
    ranked = running(dealt, ["place"], "chunk", ["slot"], "one", "rank").where("rank < need").select("slot", "place", "rank")
    lacking = grown.join(dealt.groupBy("place").agg(F.count("*").alias("dealt")), "place", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).where("dealt < need")
    closing = lacking.select("place", F.explode(F.sequence(F.col("dealt"), F.col("need") - 1)).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "place", "rank")
    return ranked.unionByName(closing)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, pieces: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot and n_stretches of every row: how many of its words the
    mix takes, the slot of the schedule that takes the first of them, and in how many stretches.

    With pieces: slot, doc_id, first and words of every stretch that a slot takes instead, in the order of training.
    Words are runs other than space and 09-0D; null and empty texts have size 0 and are taken 0 times. Documents of a
    source are shuffled by the MD5 of their doc_id, rows that share one by size. Taken never exceeds most (a whole number
    of passes) times the size. Reruns agree. Other columns are ignored; an empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    folded = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    with Scratch(docs) as scratch:
        folded = scratch.hold(folded.withColumns({"words": F.col("size") * F.col("copies"), "shuffle": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))}))
        sources = scratch.hold(targets(folded.select("source", F.col("words").alias("size")), weights, share, most).withColumn("quota", F.floor(F.col("target") + 0.5)))
        total = sources.agg(F.sum("quota")).first()[0] or 0
        # chunks of the shuffled order by leading digits, as many as the rows need
        n, rows = folded.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
        digits = min(8, max(1, math.ceil(math.log(max(1, n / ROWS_A_CHUNK), 16))))
        placed = folded.join(F.broadcast(sources) if sources.count() <= CELLS else sources, folded["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("chunk", F.substr("shuffle", F.lit(1), F.lit(digits)))
        placed = scratch.hold(running(placed, ["place"], "chunk", ["shuffle", "doc_id", "size"], "words", "start"))
        placed = spread(placed, rows)
        passes = F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1)))
        turns = placed.where("size > 0").withColumn("turn", passes).withColumn("lo", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).where("lo < hi")
        stretches = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
        slots = schedule(sources, total, block)
        first, last = F.greatest(F.col("lo"), F.col("rank") * block), F.least(F.col("hi"), (F.col("rank") + 1) * block)
        met = stretches.join(slots, ["place", "rank"]).select("slot", "place", "doc_id", "start", "size", (first - F.col("lo")).alias("first"), (last - first).alias("words"))
        if pieces:
            return checkpointed(met.select("slot", "doc_id", "first", "words"))
        # a place in its source's order names a row, also where rows share a doc_id
        used = met.groupBy("place", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_stretches"))
        none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_stretches": F.lit(0).cast("long")}
        filled = placed.where("size > 0").join(used, ["place", "start"], "left").unionByName(placed.where("size = 0").withColumns(none))
        zero = F.lit(0).cast("long")
        return checkpointed(filled.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), "first_slot", F.coalesce("n_stretches", zero).alias("n_stretches")))
