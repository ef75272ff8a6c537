"""WARC revisit records resolved to the responses they stand for, as an as-of join.

A revisit record of profile "server not modified" has no body: it says that the latest earlier full response of its URL
still held. Records are keyed by canonical URL; each revisit takes the last full response before it, by time and then
record_id. The join is a running "last response" within chunks of time, with what earlier chunks leave carried over, so
a URL with a third of all records is many tasks. Bodies don't travel with it: they are joined by record_id at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import checkpointed

#: Headers that a 304 answer may update (fixed by the HTTP caching standard).
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
CHUNK_SECONDS = 3600
#: A response that more than one in SHARE records resolve to has its body sent to SALTS tasks.
SHARE = 1024
SALTS = 64


def canonical(url: Column) -> Column:
    """A url's key: without scheme, user, leading www., default port, fragment, tracking parameters, a directory's index
    file and closing slashes; the host is in lower case. Null stays null."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^[^@]*@", ""), ":(80|443)$", "")
    host = F.regexp_replace(host, "^www[0-9]?\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/(index\\.(html?|php))?/*$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(rest, "\\?(.*)$", 1)), "&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, "^&+", ""), "&+$", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, body: str | None = None, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """record_id, canonical_url, ts, kind, outcome, resolved_id, merged (headers) and, if named, the body of every record.

    records: record_id, url, ts (seconds), kind ('response' or 'revisit'), headers (map, names in any case), body.
    outcome is 'response' (a full response resolves to itself), 'resolved', 'mismatch' (the earlier response's validators
    differ) or 'orphan' (no earlier response, or no url or ts). Entity tags are compared weakly if both have one, else
    last-modified if both have one; with no common validator the revisit resolves. merged is the response's headers, with
    those of the revisit that a 304 may update laid over them; for other outcomes the record's own. A name that a record
    has in several spellings takes the value of the first spelling by code points. Records of equal url and ts are ordered
    by record_id, nulls first. A null map of headers is empty. Rows that share a record_id are resolved one by one and
    should share a body; a response without record_id has none. Other columns are ignored; an empty table gives an empty
    result.
    """
    spelt = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value")))
    r = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", F.array_sort(spelt).alias("spelt"))
    once = F.filter("spelt", lambda e, i: ~e["name"].eqNullSafe(F.get("spelt", i - 1)["name"]))
    r = r.withColumn("headers", F.map_from_entries(F.transform(once, lambda e: F.struct(e["name"], e["value"])))).drop("spelt")
    r = r.withColumn("chunk", F.floor(F.col("ts") / chunk_seconds))
    r = r.withColumn("full", F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", "record_id", F.to_json(F.col("headers")).alias("json"))))
    can = r.where("canonical_url is not null and ts is not null")
    left = can.groupBy("canonical_url", "chunk").agg(F.max("full").alias("last"))
    carried = left.select("canonical_url", "chunk", F.last("last", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    within = W.partitionBy("canonical_url", "chunk").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    seen = can.withColumn("near", F.last("full", ignorenulls=True).over(within)).join(carried, ["canonical_url", "chunk"])
    seen = seen.withColumn("base", F.coalesce("near", "carried")).select("record_id", "canonical_url", "ts", "kind", "headers", "base")
    rest = r.where("canonical_url is null or ts is null").select("record_id", "canonical_url", "ts", "kind", "headers", F.lit(None).cast(seen.schema["base"].dataType).alias("base"))
    out = seen.unionByName(rest).withColumn("earlier", F.from_json("base.json", "map<string,string>"))
    tags = _weak(F.element_at("headers", "etag")), _weak(F.element_at("earlier", "etag"))
    dates = F.element_at("headers", "last-modified"), F.element_at("earlier", "last-modified")
    agree = F.coalesce(tags[0] == tags[1], dates[0] == dates[1], F.lit(True))
    outcome = F.when(F.col("kind") == "response", "response").when(F.col("base").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    out = out.withColumn("outcome", outcome)
    new = F.map_filter("headers", lambda k, v: k.isin(*UPDATABLE))
    kept = F.map_filter("earlier", lambda k, v: ~F.map_contains_key(new, k))
    out = out.select(
        "record_id",
        "canonical_url",
        "ts",
        "kind",
        "outcome",
        F.when(F.col("outcome") == "response", F.col("record_id")).when(F.col("outcome") == "resolved", F.col("base.record_id")).alias("resolved_id"),
        F.when(F.col("outcome") == "resolved", F.map_concat(kept, new)).otherwise(F.col("headers")).alias("merged"),
    )
    if body is None:
        return out
    # read three times from here on
    out = checkpointed(out)
    # a popular response's body goes to several tasks; at most SHARE ids are popular, so their list may be broadcast
    named = out.where("resolved_id is not null")
    popular = named.groupBy("resolved_id").count().where(F.col("count") > max(SALTS, out.count() // SHARE)).select(F.col("resolved_id").alias("popular"))

    def salted(df: DataFrame, salts: Column) -> DataFrame:
        wide = df.join(F.broadcast(popular), F.col("resolved_id") == F.col("popular"), "left")
        return wide.withColumn("salt", F.explode(F.when(F.col("popular").isNull(), F.array(F.lit(0))).otherwise(salts))).drop("popular")

    bodies = salted(records.where("kind = 'response'").select(F.col("record_id").alias("resolved_id"), F.col(body)), F.sequence(F.lit(0), F.lit(SALTS - 1))).dropDuplicates(["resolved_id", "salt"])
    met = salted(named, F.array(F.pmod(F.xxhash64("record_id", "ts"), F.lit(SALTS)).cast("int"))).join(bodies, ["resolved_id", "salt"], "left")
    columns = ["record_id", "canonical_url", "ts", "kind", "outcome", "resolved_id", "merged", body]
    return met.select(columns).unionByName(out.where("resolved_id is null").withColumn(body, F.lit(None).cast(records.schema[body].dataType)).select(columns))
