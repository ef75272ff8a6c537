"""Who is to be told of a confirmed match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def match_sides(matches: DataFrame) -> DataFrame:
    """JN7: one row for each side of each match: report_id (told) and other_id (told of)."""
    sides = F.array(F.struct(F.lit("missing").alias("side"), F.col("missing_id").alias("report_id"), F.col("found_id").alias("other_id")), F.struct(F.lit("found").alias("side"), F.col("found_id").alias("report_id"), F.col("missing_id").alias("other_id")))
    return matches.withColumn("_s", F.explode(sides)).select(*matches.columns, "_s.*")


def notifications(matches: DataFrame, subscribers: DataFrame, reports: DataFrame, now: int, batch: int | None = 100, hours: int = 24, legacy_cooldown: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PL13, WN9, FN34: (outbox, matches, subscribers) after a run at now (seconds).

    Only confirmed matches not told yet count, the best first; batch limits a run. A subscriber (a report's phone; several
    phones of a report are each told) is told of one match a run and rests for the hours after it. Nothing is sent of a
    report that is not there or has neither name nor place, and its match stays open for a later run. A match is done when
    every subscriber of its sides has been told of it; without any it stays open, for those who subscribe later. A
    subscriber who rests, or has been told of a better match in the run, keeps a match open too; with legacy_cooldown not."""
    open_ = matches.where("status = 'confirmed' and not coalesce(notify_sent, false)")
    if batch:
        open_ = open_.orderBy(F.col("combined_score").desc(), "id").limit(batch)
    other = reports.select(F.col("id").alias("other_id"), F.col("full_name").alias("other_name"), F.col("last_seen_location").alias("other_place"))
    s = subscribers.select("report_id", "phone", (F.coalesce(F.lit(now) - F.col("last_notified_at") < hours * 3600, F.lit(False))).alias("resting"))
    told = match_sides(open_.select("id", "missing_id", "found_id", "combined_score")).where("other_id is not null").join(s, "report_id").join(other, "other_id", "left")
    known = F.expr("coalesce(other_name, '') <> '' or coalesce(other_place, '') <> ''")
    # a subscriber's first match that can be told, in the order of matches; those after it find them told
    order = W.partitionBy("report_id", "phone").orderBy(F.col("combined_score").desc(), "id")
    told = told.withColumn("open", ~F.col("resting") & known).withColumn("before", F.coalesce(F.max("open").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    told = told.withColumn("sent", F.col("open") & ~F.col("before"))
    outbox = told.where("sent").select(F.col("id").alias("match_id"), "report_id", "phone", "side", F.concat_ws(" — ", F.nullif("other_name", F.lit("")), F.nullif("other_place", F.lit(""))).alias("text"))
    passed = F.col("sent") | (F.col("resting") | F.col("before") if legacy_cooldown else F.lit(False))
    done = told.groupBy("id").agg(F.bool_and(passed).alias("_done")).where("_done")
    after = matches.join(done, "id", "left").withColumn("notify_sent", F.coalesce("_done", "notify_sent")).drop("_done")
    sent = outbox.select("report_id", "phone").distinct().withColumn("_now", F.lit(now))
    return outbox, after, subscribers.join(sent, ["report_id", "phone"], "left").withColumn("last_notified_at", F.coalesce("_now", "last_notified_at")).select(subscribers.columns)


def not_blocked(rows: DataFrame, blocked: DataFrame, key: str = "phone") -> DataFrame:
    """JN9: rows whose key is not blocked."""
    return rows.join(blocked.select(key), key, "left_anti")
