"""URL filtering by the ratio of two character language models, with DataFrame functions only.

Rules give the verdict where one fits, and their URLs are the examples: one smoothed variable-order Markov model is learnt
from those allowed, one from those blocked. A URL that no rule fits is judged by its mean log-likelihood difference per
character against a threshold calibrated on examples that the models have not seen.

The models know contexts of up to ORDER symbols. Each estimate is interpolated with that of the next shorter context, down
to even chances for all symbols, and a context weighs more the oftener it was seen and the fewer symbols have followed it
(Witten-Bell); so each place in a URL is judged at the depth for which there are counts. The counts grow with the URLs:
they are tables that are joined by gram, and only grams so frequent that there can be few of them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import Scratch, checkpointed

#: Symbols of the longest context, and how many symbols there are.
ORDER = 5
SYMBOLS = 41
#: Contexts up to so many symbols have at most SYMBOLS ** (SHORT + 1) entries, which may be broadcast.
SHORT = 2
#: Keys that hold more than one in SHARE rows are at most SHARE; their entries are broadcast, all others are joined.
SHARE = 4096
#: Cells of the held-out scores' histogram: bins a unit of the score, and the score beyond which rows share the last bin.
BINS = 500
REACH = 4.0

Rules = tuple[tuple[str, str, str], ...]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.element_at(F.split(rest, "[?#]", 2), 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _symbols(url: Column) -> Column:
    """A url in the models' alphabet: a-z, 0-9, '.', '-', '/' and '_' (of A-Z the lower case), '~' for each other character,
    and '^' before it, ORDER times, and after it."""
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(F.lower(url), "[^a-z0-9./_-]", "~"), F.lit("^"))


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each symbol, and the end, of a url: it with the ORDER symbols before it."""
    at = F.explode(F.sequence(F.lit(1), F.length("symbols") - ORDER))
    return df.select(*keep, _symbols(F.col("url")).alias("symbols")).select(*keep, "symbols", at.alias("at")).select(*keep, F.expr(f"substring(symbols, at, {ORDER + 1})").alias("gram"))


def ratios(counts: DataFrame) -> DataFrame:
    """gram and ratio: difference of the log-probabilities of its last symbol after the others in the two models.

    counts: gram, n0 and n1, how often the blocked and the allowed examples have it. Grams of 0 and 0 get the ratio of the
    longest suffix that was seen. All suffixes of grams, which their lengths tell apart, are one table, so the plan doesn't
    grow with ORDER. Suffixes of few symbols are broadcast; no key of a join has more than SYMBOLS ** (ORDER - SHORT - 1)
    rows, and no context more than SYMBOLS.
    """
    sides = (0, 1)
    suffixes = counts.select("gram", "n0", "n1", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).withColumn("e", F.expr(f"substring(gram, {ORDER + 1} - k)"))
    entries = suffixes.groupBy("e").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in sides)).withColumn("h", F.expr("substring(e, 1, length(e) - 1)"))
    same = W.partitionBy("h")
    seen = [(F.sum(f"n{i}").over(same).alias(f"c{i}"), F.sum((F.col(f"n{i}") > 0).cast("int")).over(same).alias(f"t{i}")) for i in sides]
    entries = entries.select("e", F.struct((F.length("e") - 1).alias("k"), "n0", "n1", *(c for pair in seen for c in pair)).alias("entry"))
    short = suffixes.where(F.col("k") <= SHORT).select("gram", "e").join(F.broadcast(entries.where(F.length("e") <= SHORT + 1)), "e")
    long = suffixes.where(F.col("k") > SHORT).select("gram", "e").join(entries.where(F.length("e") > SHORT + 1), "e")
    deeper = short.unionByName(long).groupBy("gram").agg(F.array_sort(F.collect_list("entry")).alias("entries"))

    def mixed(p: Column, x: Column) -> Column:
        """The chances in the next longer context."""
        return F.struct(*(F.when(x[f"t{i}"] > 0, (x[f"n{i}"] + x[f"t{i}"] * p[f"p{i}"]) / (x[f"c{i}"] + x[f"t{i}"])).otherwise(p[f"p{i}"]).alias(f"p{i}") for i in sides))

    even = F.struct(*(F.lit(1.0 / SYMBOLS).alias(f"p{i}") for i in sides))
    return deeper.select("gram", F.aggregate("entries", even, mixed).alias("p")).select("gram", (F.log("p.p1") - F.log("p.p0")).alias("ratio"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, often: int) -> DataFrame:
    """rows with the columns of table (one row for each key, and n, how many rows have it): what more than often rows ask
    for is broadcast, so that no task gets all rows of a frequent key."""
    frequent = F.broadcast(table.where(F.col("n") > often).drop("n"))
    rare = rows.join(frequent.select(key), key, "left_anti").join(table.where(F.col("n") <= often).drop("n"), key)
    return rows.join(frequent, key).unionByName(rare)


def _often(table: DataFrame) -> int:
    return (table.agg(F.sum("n")).first()[0] or 0) // SHARE


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold for every row of pages.

    The longest rule that fits a url gives its verdict; a rule fits its host and all subdomains where the path starts with
    the rule's. Other urls are allowed if their score (null where a rule decides) is at least the threshold. The whole url
    is scored, with its scheme and what follows the path. Models are learnt from three quarters of the distinct urls that
    rules decide; the threshold is the one nearest to 0 at which the other quarter has the least balanced error, and 0 where
    either side has no examples there. Repeated urls are learnt and scored once. Null urls and urls without :// have empty
    host and path and no rule; a null url is scored as the empty text. Rows that share a page_id are returned one by one;
    other columns are ignored; an empty table gives an empty result. Tables of counts are written to the checkpoint folder
    when this is called, and deleted again.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    with Scratch(pages) as scratch:
        allowed, fold = (F.col("by_rule") == "allow").cast("int").alias("allowed"), F.pmod(F.xxhash64("url"), F.lit(4))
        distinct = rows.groupBy("url").agg(F.count("*").alias("n"), F.first("by_rule").alias("by_rule"))
        distinct = scratch.hold(distinct.select("url", "n", allowed, F.when(F.col("by_rule").isNotNull(), fold != 0).otherwise(False).alias("learnt"), F.monotonically_increasing_id().alias("id")))
        sums = (F.sum((F.col("learnt") & (F.col("allowed") == side)).cast("long")).alias(f"n{side}") for side in (0, 1))
        counts = scratch.hold(_grams(distinct, "learnt", "allowed").groupBy("gram").agg(F.count("*").alias("n"), *(F.coalesce(c, F.lit(0)).alias(f"n{i}") for i, c in enumerate(sums))))
        model = scratch.hold(ratios(counts).join(counts.select("gram", "n"), "gram"))
        judged = distinct.where("not learnt")
        sums = _looked_up(_grams(judged, "id"), model, "gram", _often(model)).groupBy("id").agg(F.sum("ratio").alias("sum"))
        score = F.round(F.col("sum") / (F.length(_symbols(F.col("url"))) - ORDER), 9)
        scored = checkpointed(judged.join(sums, "id").select("url", "n", "allowed", score.alias("score")))
    # a histogram of fixed size stands for the held-out scores
    held = scored.where("allowed is not null")
    bins = held.groupBy(F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("score"))) * BINS).alias("bin")).agg(F.sum("allowed").alias("good"), F.sum(1 - F.col("allowed")).alias("bad"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    cuts = bins.select(
        "bin",
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("stopped"),
        F.sum("good").over(all_).alias("goods"),
        F.sum("bad").over(all_).alias("bads"),
    )
    error = F.col("lost") / F.col("goods") + 1 - F.col("stopped") / F.col("bads")
    best = cuts.where("goods > 0 and bads > 0").select(F.round(error, 9).alias("error"), "bin")
    least = best.agg(F.min_by(F.col("bin"), F.struct("error", F.abs("bin"), "bin")).alias("bin"))
    threshold = F.broadcast(least.select(F.coalesce(F.col("bin") / BINS, F.lit(0.0)).alias("threshold"), F.lit(True).alias("open")))
    open_ = rows.where("rule is null").select("page_id", "url", "host", "path", "rule")
    by_score = _looked_up(open_, scored.where("allowed is null").select("url", "n", "score"), "url", _often(scored)).withColumn("open", F.lit(True)).join(threshold, "open")
    by_score = by_score.select("page_id", "host", "path", "rule", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block").alias("verdict"), "score", "threshold")
    none = F.lit(None).cast("double")
    return rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), none.alias("score"), none.alias("threshold")).unionByName(by_score)
