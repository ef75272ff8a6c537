"""Duplicate reports: by identifier, by name within blocks, and the canonical view."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fuzzy, text
from .upsert import checkpointed, mark_duplicates


#: Columns that blocks are by, and names of a block that one task compares with as many others.
BLOCK = ("kind", "_first", "_place")
TILE = 512
#: Reports of a block that meet as many others in one group of a join.
MEET = 4096
#: Pairs of alike names of a block that one task settles in a loop.
SMALL = 50_000
#: Pairs of names that are compared at once.
PAIRS = 16_384


def _rank(marks: bool = True) -> list[Column]:
    m = F.col("distinguishing_marks") if marks else F.lit(None).cast("string")
    score = text.status_rank(F.col("kind"), m), text.completeness(F.col("age"), F.col("last_seen_location"), m)
    return [score[0].desc(), score[1].desc(), F.col("created_at").asc_nulls_last(), F.col("id").asc()]


def pick_canonical(df: DataFrame, *cluster: str) -> DataFrame:
    """AG4: df with canonical, the id of its cluster's best row: by status, completeness, age of the report and id."""
    return df.withColumn("canonical", F.first("id").over(W.partitionBy(*cluster).orderBy(*_rank()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def dedup_by_id(reports: DataFrame) -> DataFrame:
    """PL1: (id, canonical) of reports that share kind and identifier with a better one; a column cedula is taken for it."""
    known = reports.withColumn("_ci", F.col("cedula") if "cedula" in reports.columns else text.extract_id(F.col("distinguishing_marks"))).where("_ci is not null")
    return pick_canonical(known, "kind", "_ci").where("id <> canonical").select("id", "canonical")


def blocks(reports: DataFrame) -> DataFrame:
    """JN10: reports with block columns: kind, first word of the name, canonical place (30 characters)."""
    first = F.try_element_at(text.tokens(F.lower("full_name")), F.lit(1))
    return reports.withColumn("_first", first).withColumn("_place", F.substring(F.coalesce(text.normalize_location(F.col("last_seen_location")), F.lit("")), 1, 30)).where("_first is not null")


def block_pairs(reports: DataFrame) -> DataFrame:
    """JN10: (a, b, a_name, b_name) of reports in one block, a before b.

    Pairs grow with the square of a block. Blocks of more than MEET reports are cut into tiles by hash, and each pair of
    tiles meets by itself, so a group of the join stays small and a block's pairs are many tasks' work."""
    b = blocks(reports).where("id is not null").select(*BLOCK, "id", "full_name")
    held = b.groupBy(*BLOCK).agg(F.ceil(F.count("*") / MEET).cast("int").alias("tiles"))
    tiled = b.join(held, list(BLOCK)).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    spark = reports.sparkSession
    # a pair of tiles is few bytes and much work, so partitions must not be put together by their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)

    def dealt(own: str, other: str, others: str, named: dict) -> DataFrame:
        sent = tiled.select(*BLOCK, "id", "full_name", F.col("tile").alias(own), F.explode(F.expr(others)).alias(other))
        return sent.withColumnsRenamed(named).repartition(tasks, *BLOCK, "p", "q")

    left = dealt("p", "q", "sequence(tile, tiles - 1)", {"id": "x", "full_name": "x_name"})
    right = dealt("q", "p", "sequence(0, tile)", {"id": "y", "full_name": "y_name"})
    # keys are made of few bytes that Spark goes by, so without the hint it may gather a side for a broadcast
    met = left.hint("merge").join(right, [*BLOCK, "p", "q"]).where("p < q or x < y")
    first = F.col("x") < F.col("y")
    return met.select(*(F.when(first, F.col(one)).otherwise(F.col(other)).alias(name) for name, one, other in (("a", "x", "y"), ("b", "y", "x"), ("a_name", "x_name", "y_name"), ("b_name", "y_name", "x_name"))))


def block_links(reports: DataFrame) -> DataFrame:
    """JN10 without its pairs: (id, block, n_links): reports of one block are all linked, so the block's smallest id and the
    number of others in it say the same, in a row a report."""
    b = blocks(reports)
    size = b.groupBy(*BLOCK).agg(F.min("id").alias("block"), (F.count("*") - 1).alias("n_links"))
    return b.select("id", *BLOCK).join(size, list(BLOCK)).select("id", "block", "n_links")


def name_classes(reports: DataFrame) -> DataFrame:
    """(id, anchor) of reports with a block: the smallest id of its block's reports of the same name."""
    b = blocks(reports).select("id", *BLOCK, F.col("full_name").alias("name"))
    return b.join(_compact(blocks(reports)).withColumnRenamed("full_name", "name"), [*BLOCK, "name"]).select("id", "anchor")


def name_pairs(reports: DataFrame) -> DataFrame:
    """JN10 by names: (a, b, a_name, b_name) of a block's distinct names wherever a report of the first comes before one of the
    second, also twice the same name; a and b are the names' smallest ids. With name_classes these are all of block_pairs."""
    n = blocks(reports).groupBy(*BLOCK, "full_name").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    left = n.select(*BLOCK, F.col("first").alias("a"), F.col("full_name").alias("a_name"))
    right = n.select(*BLOCK, F.col("first").alias("b"), F.col("full_name").alias("b_name"), "last")
    return left.join(right, list(BLOCK)).where("a < last").select("a", "b", "a_name", "b_name")


def _compact(blocked: DataFrame) -> DataFrame:
    """One row for each distinct name of a block, with the id of its first report: a block's work and memory then follow
    its distinct names, however many reports repeat them."""
    return blocked.groupBy("kind", "_first", "_place", "full_name").agg(F.min("id").alias("anchor"))


def _alike(names: DataFrame, threshold: float) -> DataFrame:
    """(block columns, anchor, other) of a block's distinct names that reach the threshold, the earlier first. Large blocks
    are compared tile by tile, each pair of tiles in a task of its own."""
    held = names.groupBy(*BLOCK).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = names.join(held, list(BLOCK)).withColumn("tile", F.pmod(F.xxhash64("full_name"), F.col("tiles")).cast("int")).withColumn("to", F.explode(F.expr("sequence(0, tiles - 1)")))
    tiled = tiled.select(*BLOCK, "anchor", "full_name", "tile", F.least("tile", "to").alias("p"), F.greatest("tile", "to").alias("q"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("anchor")
        anchor, names, tile = (pdf[c].to_numpy() for c in ("anchor", "full_name", "tile"))
        across = pdf["p"].iloc[0] != pdf["q"].iloc[0]
        out = []
        for i in range(len(pdf)):
            j = np.arange(i + 1, len(pdf))
            out.append(np.stack([np.full(len(j), i), j])[:, tile[j] != tile[i]] if across else np.stack([np.full(len(j), i), j]))
        i, j = np.concatenate(out, 1)
        alike = np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS):
            x, y = names[i[at : at + PAIRS]].tolist(), names[j[at : at + PAIRS]].tolist()
            alike[at : at + PAIRS] = fuzzy.weighted_ratios(x, y, threshold) >= threshold
        return pd.DataFrame({"anchor": anchor[i[alike]], "other": anchor[j[alike]]}, dtype=object).assign(**{c: pdf[c].iloc[0] for c in BLOCK})

    return tiled.groupBy(*BLOCK, "p", "q").applyInPandas(compare, "anchor string, other string, kind string, _first string, _place string")


def _settled(edges: DataFrame) -> DataFrame:
    """other, of all nodes that an earlier anchor takes, by rounds over the pairs (anchor, other), the earlier first.

    A node without an earlier neighbour is an anchor, and its neighbours leave; what is left is looked at anew. That is the
    loop over nodes in their order, many steps at a time. Each round is a few joins and is held in the checkpoint folder;
    their number is that of turns on the longest chain of names, each like the next only."""
    left, taken = checkpointed(edges.select("anchor", "other")), None
    while not left.isEmpty():
        later = left.select(F.col("other").alias("anchor")).distinct()
        gone = checkpointed(left.join(later, "anchor", "left_anti").select("other").distinct())
        taken = gone if taken is None else taken.unionByName(gone)
        # of an anchor's pairs all others are gone; no pair of a gone node counts any more
        left = checkpointed(left.join(gone, "other", "left_anti").join(gone.select(F.col("other").alias("anchor")), "anchor", "left_anti"))
    return edges.select("other").limit(0) if taken is None else taken


def greedy_clusters(edges: DataFrame) -> DataFrame:
    """PL2: (anchor, cluster) of the nodes that an earlier one takes. edges: block columns, anchor, other, the earlier first.

    In the order of ids, a node that no cluster has becomes an anchor and takes all later neighbours that no cluster has.
    Blocks of up to SMALL pairs are one task's loop each; larger ones are settled together in rounds."""
    n = edges.groupBy(*BLOCK).agg(F.count("*").alias("_pairs"))
    sized = edges.join(n, list(BLOCK))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster: dict[str, str] = {}
        for a, other in sorted(zip(pdf["anchor"], pdf["other"], strict=True)):
            if a not in cluster:
                cluster.setdefault(other, a)
        return pd.DataFrame(list(cluster.items()), columns=["anchor", "cluster"])

    small = sized.where(F.col("_pairs") <= SMALL).groupBy(*BLOCK).applyInPandas(greedy, "anchor string, cluster string")
    large = sized.where(F.col("_pairs") > SMALL).select("anchor", "other")
    if large.isEmpty():
        return small
    taken = _settled(large)
    # a taken node goes to the first of its anchors
    own = large.join(taken.select(F.col("other").alias("anchor")), "anchor", "left_anti").groupBy("other").agg(F.min("anchor").alias("cluster"))
    return small.unionByName(own.select(F.col("other").alias("anchor"), "cluster"))


def dedup_by_name(reports: DataFrame, threshold: float = 85.0, use_marks: bool = False) -> DataFrame:
    """PL2: (id, canonical): within each block, in the order of ids, a report that no cluster has yet becomes an anchor and
    takes all later ones whose names reach the threshold. Not transitive. Equal names cluster alike, so names are compared
    once each; the greedy pass only follows the pairs that reach the threshold, which are held in the checkpoint folder."""
    b = blocks(reports)
    names = _compact(b)
    placed = names.join(greedy_clusters(checkpointed(_alike(names, threshold))), "anchor", "left").withColumn("cluster", F.coalesce("cluster", "anchor"))
    placed = b.join(placed.drop("anchor"), [*BLOCK, "full_name"])
    best = F.first("id").over(W.partitionBy(*BLOCK, "cluster").orderBy(*_rank(use_marks)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return placed.withColumn("canonical", best).where("id <> canonical").select("id", "canonical")


def dedup(reports: DataFrame, threshold: float = 85.0) -> DataFrame:
    """PL3: reports with dup_of. The name pass sees only what the identifier pass has left, so the two can't point at each
    other; running it again changes nothing."""
    open_ = reports.where("dup_of is null") if "dup_of" in reports.columns else reports
    by_id = dedup_by_id(open_)
    rest = open_.join(by_id.select("id"), "id", "left_anti")
    return mark_duplicates(reports, by_id.unionByName(dedup_by_name(rest, threshold)))


def canonical_reports(reports: DataFrame) -> DataFrame:
    """PL4: reports that are no duplicates."""
    return reports.where("dup_of is null")


def duplicate_counts(reports: DataFrame) -> DataFrame:
    """AG2: all reports and canonical ones."""
    return reports.agg(F.count("*").alias("reports"), F.count_if(F.col("dup_of").isNull()).alias("canonical"))
