"""Conversations by key and time, as batch windows; kindred.streaming has the stateful twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fuzzy, text


def _upto(key: str, *order: str):
    return W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def last_n(df: DataFrame, key: str, order: list[str], value: str, n: int = 10, name: str = "history") -> DataFrame:
    """WN5: df with the last n values up to each row."""
    return df.withColumn(name, F.collect_list(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)))


def running_count(df: DataFrame, key: str, order: list[str], name: str = "n_messages") -> DataFrame:
    """WN6."""
    return df.withColumn(name, F.count("*").over(_upto(key, *order)))


def latest_active(conversations: DataFrame, keys: list[str], ts: str = "last_message_at") -> DataFrame:
    """WN7: each key's active conversation with the latest message."""
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc(), "conv_id")
    return conversations.where("active").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carry_forward(df: DataFrame, key: str, order: list[str], fields: list[str], reset: Column) -> DataFrame:
    """WN8, SM8: each field's last value since the last reset, which begins anew with its own row."""
    d = df.withColumn("_part", F.sum(F.when(reset, 1).otherwise(0)).over(_upto(key, *order)))
    w = W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields}).drop("_part")


#: What an intake form asks for, in this order (fixed values).
FORM = ("name", "cedula", "age", "location", "description", "contact")


def intake_state(messages: DataFrame, key: str = "phone", order: tuple[str, ...] = ("ts", "id"), people: bool = False) -> DataFrame:
    """SM8: messages with kind and the form's fields as collected since the last restart, and next_field: the first of FORM
    that is neither collected, skipped nor covered; null when the form is complete.

    messages: key, order, restart, any of kind, FORM's fields and has_photo, and skipped (array of fields). Blank values
    count as none. What is skipped stays so until the restart; a photo, too, covers the description, and the name of a
    found person. With people, a name that is not the person's so far also restarts the form (SM9), with its own message
    in it."""
    names = [c for c in ("kind", *FORM) if c in messages.columns]
    none = {c: F.lit(None).cast("string") for c in ("kind", *FORM) if c not in messages.columns}
    m = messages.withColumns({c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in names} | none)
    skipped = F.coalesce("skipped", F.array().cast("array<string>")) if "skipped" in m.columns else F.array().cast("array<string>")
    photo = F.col("has_photo") if "has_photo" in m.columns else F.lit(False)
    m = m.withColumns({f"_skip_{f}": F.when(F.array_contains(skipped, f), True) for f in FORM} | {"_photo": F.when(photo, True)})
    reset = F.col("restart")
    if people:
        m = m.withColumn("_form", F.concat_ws("|", F.col(key).cast("string"), F.sum(F.when(reset, 1).otherwise(0)).over(_upto(key, *order)).cast("string")))
        m = split_people(m, "_form", order)
        reset = reset | F.coalesce(F.col("person") != F.lag("person").over(W.partitionBy("_form").orderBy(*order)), F.lit(False))
        m = m.withColumn("_reset", reset)
        reset = F.col("_reset")
    state = carry_forward(m, key, list(order), ["kind", *FORM, "_photo", *(f"_skip_{f}" for f in FORM)], reset)
    covered = {"description": F.col("_photo").isNotNull(), "name": F.col("_photo").isNotNull() & F.coalesce(F.col("kind") == "found", F.lit(False))}

    def lacks(f):
        return F.col(f).isNull() & F.col(f"_skip_{f}").isNull() & ~covered.get(f, F.lit(False))

    helpers = ["_photo", *(f"_skip_{f}" for f in FORM), *(("_form", "_reset", "person") if people else ())]
    return state.withColumn("next_field", F.coalesce(*(F.when(lacks(f), f) for f in FORM))).drop(*helpers)


def recent_mode(df: DataFrame, key: str, value: str, order: list[str], n: int = 10) -> DataFrame:
    """AG6: each key's most frequent value among its last n, ties to the most recent."""
    w = W.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    last = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    counts = last.groupBy(key, value).agg(F.count("*").alias("c"), F.min("_n").alias("near"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("c", (-F.col("near")).alias("r"))).alias(value))


def interests(df: DataFrame, key: str, order: list[str], topic: str, preference: str) -> DataFrame:
    """WN10, AG5: each row's ordered distinct topics so far, and the latest preference. The running list takes a topic where
    it first occurs, so it is no longer than the key's topics."""
    w = _upto(key, *order)
    first = F.when(F.row_number().over(W.partitionBy(key, topic).orderBy(*order)) == 1, F.col(topic))
    return df.withColumn("_first", first).withColumn("topics", F.collect_list("_first").over(w)).withColumn("latest", F.last(preference, ignorenulls=True).over(w)).drop("_first")


def active_sessions(df: DataFrame, now: int, ts: str = "ts", days: int = 7) -> DataFrame:
    """SM4: rows of the last days."""
    return df.where(F.col(ts) >= now - days * 86400)


def bursts(df: DataFrame, key: str, ts: str = "ts", gap: int = 60, most: int = 5) -> DataFrame:
    """SM5: (key, begins, ends, n, ids): events of a key not over gap seconds apart, the first most ids of each."""
    w = W.partitionBy(key).orderBy(ts, "id")
    d = df.withColumn("_new", F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1)).withColumn("_burst", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy(key, "_burst").orderBy(ts, "id")))
    first = F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "id")))
    return d.groupBy(key, "_burst").agg(F.min(ts).alias("begins"), F.max(ts).alias("ends"), F.count("*").alias("n"), F.transform(F.array_sort(first), lambda s: s["id"]).alias("ids")).drop("_burst")


def rate_limit(df: DataFrame, key: str = "phone", ts: str = "ts", n: int = 20, window_s: float = 60) -> DataFrame:
    """SM2: df with accepted: at most n accepted events in any window. Rejected events don't count, and one exactly a window
    old still does, so acceptance depends on earlier acceptance: a key's events are folded in order. A key's rows come in
    sorted batches and only n times are held, so a key of any size fits a task."""
    names = df.columns
    ordered = df.repartition(key).sortWithinPartitions(key, ts, "id")

    def fold(batches):
        current, times = object(), []
        for pdf in batches:
            ok = []
            for k, t in zip(pdf[key], pdf[ts], strict=True):
                if k != current:
                    current, times = k, []
                times = [x for x in times if t - x <= window_s]
                ok.append(len(times) < n)
                if ok[-1]:
                    times.append(t)
            yield pdf.assign(accepted=ok)[[*names, "accepted"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ordered.mapInPandas(fold, f"{fields}, accepted boolean")


def next_person(name: str | None, person: int, new) -> tuple[str | None, int]:
    """SM9: the name and number of the person after a message with a name, or none: a name that is not the person's so far
    begins another; every name that is given replaces the one before."""
    if not isinstance(new, str) or not new.strip():
        return name, person
    return new, person + (name is not None and not fuzzy.one_person(name, new))


def split_people(df: DataFrame, key: str = "phone", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """SM9: df with person, a number that rises whenever a message's name is not the person's so far. Batches come sorted by
    key; the last name is all that is held."""
    ordered = df.repartition(key).sortWithinPartitions(key, *order)
    names = df.columns

    def fold(batches):
        current, name, person = object(), None, 0
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf["name"], strict=True):
                if k != current:
                    current, name, person = k, None, 0
                name, person = next_person(name, person, v)
                out.append(person)
            yield pdf.assign(person=pd.array(out, dtype="int64"))[[*names, "person"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ordered.mapInPandas(fold, f"{fields}, person long")


def event_metrics(events: DataFrame) -> DataFrame:
    """AG9: events by type: their number, the mean and the largest of the number k in their JSON, and mean value."""
    k = F.from_json("props", "k double")["k"]
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("avg_k"), F.max(k).alias("max_k"), F.round(F.avg("value"), 6).alias("avg_value"))


#: What an event's JSON may state, in any of its forms.
PAYLOAD = "intent string, confidence double, intent_confidence double, similarity_confidence double, node_key string, current_node string, target_node string, metodo string, latency_ms double, response_length double, urgencia string"


def event_payloads(events: DataFrame, column: str = "data") -> DataFrame:
    """AG9: events with intent, confidence, similarity, node, method, latency_ms and length, whichever form their JSON has:
    an intent that was detected, a decision (whose node is the one decided on), or a response. Malformed JSON gives nulls;
    the confidence of an intent that is none is none."""
    p = F.from_json(column, PAYLOAD)
    out = {
        "intent": F.nullif(p["intent"], F.lit("none")), "confidence": F.when(~F.coalesce(p["intent"] == "none", F.lit(False)), F.coalesce(p["confidence"], p["intent_confidence"])), "similarity": p["similarity_confidence"],
        "node": F.coalesce(p["target_node"], p["node_key"]), "method": p["metodo"], "latency_ms": p["latency_ms"], "length": p["response_length"],
    }
    return events.withColumns(out)


def event_sketches(events: DataFrame, day: Column, k: int = 200) -> DataFrame:
    """AG9: a row for each day, event_type and node of event_payloads: counts, sums, and quantile sketches of confidence and
    latency. Days are added up by merged_sketches, without a look at the events."""
    sketch = lambda c: F.kll_sketch_agg_double(c, F.lit(k)).alias(f"{c}_sketch")
    return events.groupBy(day.alias("day"), "event_type", "node").agg(
        F.count("*").alias("n"), F.count("intent").alias("n_intents"), F.count("confidence").alias("n_confidence"), F.sum("confidence").alias("confidence_sum"), F.count("latency_ms").alias("n_latency"), F.sum("latency_ms").alias("latency_sum"), F.max("latency_ms").alias("latency_max"), sketch("confidence"), sketch("latency_ms")
    )


def merged_sketches(sketches: DataFrame, by: tuple[str, ...] = ("event_type", "node"), quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """AG9: counts, means, and quantiles (within about 1.3 % of rank with the usual k) over all days of the sketches. Groups
    without a number have null means and quantiles."""
    add = lambda c: F.sum(c).alias(c)
    out = sketches.groupBy(*by).agg(*map(add, ("n", "n_intents", "n_confidence", "confidence_sum", "n_latency", "latency_sum")), F.max("latency_max").alias("latency_max"), *(F.kll_merge_agg_double(f"{c}_sketch").alias(f"{c}_sketch") for c in ("confidence", "latency_ms")))
    at = [F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(f"{c}_sketch", F.lit(q))).alias(f"{c}_p{round(100 * q)}") for c, n in (("confidence", "n_confidence"), ("latency_ms", "n_latency")) for q in quantiles]
    means = [F.when(F.col(n) > 0, F.col(s) / F.col(n)).alias(a) for a, s, n in (("avg_confidence", "confidence_sum", "n_confidence"), ("avg_latency", "latency_sum", "n_latency"))]
    return out.select(*by, "n", "n_intents", *means, "latency_max", *at)


def incoming(messages: DataFrame) -> DataFrame:
    """SM10, FN42: messages from people: of type message, not our own, no broadcast, with text or media."""
    p = messages
    return p.where("event = 'message' and not coalesce(from_me, false) and not sender like '%@broadcast'").where("coalesce(trim(body), '') <> '' or media_url is not null").withColumn("phone", F.regexp_extract("sender", "^\\+?([0-9]+)", 1)).withColumn("text", text.normalize_message(F.col("body")))
