"""Merging, ignoring and collapsing rows by key: snapshots in, snapshot out."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def checkpointed(df: DataFrame) -> DataFrame:
    """df, held in the folder that spark.checkpoint.dir names, or that the session has; a local session without either gets
    a temporary one, on a cluster that is an error, as executors don't share such a folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def collapse_batch(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """SK3, AG8, WN2: the first row of each key in that order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("source", "source_url"), mode: str = "merge") -> DataFrame:
    """SK1 and SK2: target with updates' rows, of which keys are unique.

    merge overwrites the columns that updates has (also with nulls) and leaves the others; ignore keeps rows that are there.
    One shuffle on the keys."""
    keys = list(keys)
    if mode == "ignore":
        return target.unionByName(updates.join(target.select(keys), keys, "left_anti"), allowMissingColumns=True)
    given = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_given"))
    both = target.join(new, keys, "full")
    old = [c for c in target.columns if c not in keys]
    out = [F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old]
    return both.select(*keys, *out, *(F.col(f"_new_{c}").alias(c) for c in given if c not in old))


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SK4, SK7: existing and the first of new's rows for each key it lacks; nulls in keys count as blanks."""
    blank = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    fresh = new.select("*", *blank).dropDuplicates(names).join(existing.select(*blank), names, "left_anti").drop(*names)
    return existing.unionByName(fresh, allowMissingColumns=True)


def insert_matches(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SK4: matches with those of new whose ordered pair is not there yet."""
    return insert_new(existing, new, ["missing_id", "found_id"])


def mark_duplicates(reports: DataFrame, pointers: DataFrame) -> DataFrame:
    """SK5: reports with dup_of set from pointers (id, canonical); rows that have it already are left as they are."""
    out = reports if "dup_of" in reports.columns else reports.withColumn("dup_of", F.lit(None).cast("string"))
    p = pointers.select("id", F.col("canonical").alias("_to"))
    return out.join(p, "id", "left").withColumn("dup_of", F.coalesce("dup_of", "_to")).drop("_to")


def merge_json(df: DataFrame, updates: DataFrame, key: str = "id", column: str = "raw") -> DataFrame:
    """SK5: a map column with updates' entries laid over it; updates has one map a key."""
    u = updates.select(key, F.col(column).alias("_u"))
    kept = F.map_filter(F.coalesce(column, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("_u", k))
    return df.join(u, key, "left").withColumn(column, F.when(F.col("_u").isNull(), F.col(column)).otherwise(F.map_concat(kept, "_u"))).drop("_u")


def log_run(before: DataFrame, after: DataFrame, keys: list[str], source: str, run_type: str) -> DataFrame:
    """SK6: one row: how many keys a run inserted and how many it changed."""
    a, b = before.select(*keys, F.xxhash64(*sorted(before.columns)).alias("_a")), after.select(*keys, F.xxhash64(*sorted(before.columns)).alias("_b"))
    n = b.join(a, keys, "left").agg(F.count_if(F.col("_a").isNull()).alias("inserted"), F.count_if(F.col("_a") != F.col("_b")).alias("updated"))
    return n.select(F.lit(source).alias("source"), F.lit(run_type).alias("run_type"), "inserted", "updated", F.lit(None).cast("string").alias("error"))


def observed_upsert(target: DataFrame, updates: DataFrame, write, source: str, run_type: str, keys: tuple[str, ...] = ("source", "source_url"), noise: Column | None = None, mode: str = "merge") -> dict:
    """AG3, SK6: an upsert and what its own pass counts, as a row of the run log.

    updates that fail are counted as errors and left out: those with a null key, and all but the first of a key's rows.
    noise is a condition for rows to be counted and left out as well. checked is all of them, inserted and updated what is
    left, by whether the target has the key. The counts are observed on the plan that write, an action, runs; if it fails the
    row says so, with what it had not counted as null. One pass over target and updates, no second look at either table."""
    watch, keys = Observation(f"run-{uuid.uuid4().hex}"), list(keys)
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    flagged = updates.withColumn("_noise", F.coalesce(noise, F.lit(False)) if noise is not None else F.lit(False))
    turn = F.row_number().over(W.partitionBy(*keys).orderBy("_noise", F.xxhash64(*updates.columns)))
    flagged = flagged.withColumn("_error", null | (~F.col("_noise") & (turn > 1)))
    flagged = flagged.join(target.select(*keys, F.lit(True).alias("_there")), keys, "left")
    good = ~F.col("_noise") & ~F.col("_error")
    counts = {"checked": F.lit(True), "noise": F.col("_noise") & ~null, "errors": F.col("_error"), "inserted": good & F.col("_there").isNull(), "updated": good & F.col("_there").isNotNull()}
    if mode == "ignore":
        counts["updated"] = F.lit(False)
    # the mark keeps rows that don't count in the plan up to the observation
    seen = flagged.observe(watch, *(F.count_if(c).alias(n) for n, c in counts.items()))
    row = dict.fromkeys(counts) | {"source": source, "run_type": run_type, "error": None}
    try:
        write(upsert(target, seen.where(good).select(updates.columns), tuple(keys), mode))
        row |= watch.get
    except Exception as e:  # noqa: BLE001  the log keeps what went wrong, the caller decides
        row["error"] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return row


def upsert_actors(target: DataFrame, events: DataFrame, key: str = "phone", ts: str = "ts") -> DataFrame:
    """SK8: actors by key with the latest time seen; names come from the newest event that has one."""
    seen = events.groupBy(key).agg(F.max(ts).alias("last_seen"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col(ts))).alias("name"))
    t = target.select(key, F.col("name").alias("_name"), F.col("last_seen").alias("_seen"))
    return t.join(seen, key, "full").select(key, F.coalesce("name", "_name").alias("name"), F.greatest("last_seen", "_seen").alias("last_seen"))


def quarantine(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """DQ1: df with _violation, the names of the checks that a row fails (null counts as failing)."""
    fails = [F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]
    return df.withColumn("_violation", F.concat_ws(",", *fails))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """DQ2: rows of child whose key no parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def bad_pointers(reports: DataFrame) -> DataFrame:
    """DQ3: (id, dup_of, problem) of pointers to nothing, to themselves or to rows that are duplicates too."""
    p = reports.where("dup_of is not null").select("id", "dup_of")
    t = reports.select(F.col("id").alias("dup_of"), F.col("dup_of").alias("_next"), F.lit(True).alias("_there"))
    problem = F.when(F.col("id") == F.col("dup_of"), "self").when(F.col("_there").isNull(), "missing").when(F.col("_next").isNotNull(), "chain")
    return p.join(t, "dup_of", "left").withColumn("problem", problem).where("problem is not null").select("id", "dup_of", "problem")


def union_tagged(parts: dict[str, DataFrame], tag: str = "_table") -> DataFrame:
    """SC14, SO1: the parts one below the other, each with its name; missing columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in parts.items()))
