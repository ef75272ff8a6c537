"""Divergence of a language's sources, with terms as digests until the end.

Tasks count terms under digests of a fixed width and write, beside these counts, the string behind each digest. What is
shuffled to count is (lang, source, digest, two numbers); strings stay in the written table. There the least and the
greatest string of each digest show which digests stand for several terms: only the counts of those get a split number,
from their strings. In the end strings are joined to the terms that are returned, and to no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import Scratch, checkpointed
from ._words import short_batches, slices, word_column, words

SCALE = 1_000_000_000
#: Term counts that a task holds before it hands them on.
HELD = 1 << 20
#: Pairs of sources of terms that are weighed at a time.
PAIRS = 1 << 20
#: Groups of which a table is small enough to be sent to every task.
FEW_GROUPS = 20_000


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys (the last one first), and where runs of equal ones begin in it."""
    order = np.lexsort(keys)
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, digest, count, n_docs and term for each term of a group in a task, and a row without digest for each
    group, so that groups without terms are known.

    Terms are runs of letters: A-Z (lower-cased), a-z and characters beyond ASCII. Null text, lang and source are ''. bits
    is the width of digests."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple] = []
        size = 0
        for piece, data, off in slices(batches):
            w = words(data, off, lower=True, letters=True)
            digest = w.hash >> np.uint64(64 - bits)
            own = np.array([groups.setdefault(g, len(groups)) for g in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True)], np.int64)
            text = word_column(w).dictionary_encode()
            term = text.indices.to_numpy()
            # a term's rows of one document, then of one group
            order, at = _runs(term, w.doc)
            n = np.diff(np.append(at, len(order)))
            doc, term = w.doc[order[at]], term[order[at]]
            hashes = np.zeros(len(text.dictionary), np.uint64)
            hashes[text.indices.to_numpy()] = digest
            order, at = _runs(term, own[doc])
            if len(at):
                first = order[at]
                held.append((own[doc[first]], hashes[term[first]], np.add.reduceat(n[order], at), np.diff(np.append(at, len(order))), text.dictionary.take(pa.array(term[first]))))
                size += len(at)
            if size > HELD:
                yield merged(held, groups)
                held, size = [], 0
        names = list(groups)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.string())], COLUMNS
        )
        if held:
            yield merged(held, groups)

    def merged(held: list[tuple], groups: dict) -> pa.RecordBatch:
        own, digest, n, docs = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
        text = pa.chunked_array([x[4] for x in held]).combine_chunks().dictionary_encode()
        term = text.indices.to_numpy()
        order, at = _runs(term, own)
        first = order[at]
        names = pa.array([x[0] for x in groups], pa.string()), pa.array([x[1] for x in groups], pa.string())
        return pa.RecordBatch.from_arrays(
            [*(x.take(pa.array(own[first])) for x in names), pa.array(digest[first].view(np.int64)), pa.array(np.add.reduceat(n[order], at)), pa.array(np.add.reduceat(docs[order], at)), text.dictionary.take(pa.array(term[first])).cast(pa.string())],
            COLUMNS,
        )

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return short_batches(docs).select(*named).mapInArrow(count, "lang string, source string, digest long, count long, n_docs long, term string")


COLUMNS = ["lang", "source", "digest", "count", "n_docs", "term"]


def divergence(docs: DataFrame, least_docs: int = 3, ranks: int = 200, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank and n_terms (kept terms of the lang) for every (lang, source) group of docs.

    A lang keeps the terms that at least least_docs of its rows have. A group's p of a kept term is
    1 + floor(SCALE * (count + 1) / (N + V)), count being its occurrences in the group, N their sum and V the number of the
    lang's kept terms. Part pair: item is another source of the lang, value the sum over all kept terms of
    floor((p - q) ** 2 / q) with that source's p as q, 0 without kept terms; all ranks. Part term: item is a kept term with
    occurrences and p over the lang's own p, value the same with that as q; up to ranks. Ranks go by value, then by item.

    Null text, lang and source are ''; every row is a document, also rows that share a doc_id; a group without terms has
    its pairs. Other columns are ignored. An empty table gives an empty result. bits is the width of digests: fewer give
    the same result with more of them split. Sums that the terms of two sources without occurrences add are taken from
    the sources' numbers of terms by count, so that only terms that both have are weighed one by one.
    """
    with Scratch(docs) as scratch:
        counted = scratch.hold(term_counts(docs, bits))
        return checkpointed(_report(counted, scratch, least_docs, ranks))


def _p(count: str, n: str) -> str:
    """SQL of p, with a product that goes beyond 64 bits."""
    return f"1L + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({n} + v AS DECIMAL(20,0))"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _split_terms(counted: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """counted with split, the number of a term among those of its digest, and the terms' strings by digest and split."""
    ends = scratch.hold(counted.where("digest is not null").groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")))
    clash, strings = ends.where("lo <> hi").select("digest"), ends.where("lo = hi").select("digest", F.lit(0).alias("split"), F.col("lo").alias("term"))
    if clash.isEmpty():
        return counted.withColumn("split", F.when(F.col("digest").isNotNull(), F.lit(0))), strings
    several = counted.join(clash, "digest", "left_semi").select("digest", "term").distinct()
    several = scratch.hold(several.withColumn("split", F.row_number().over(W.partitionBy("digest").orderBy("term"))))
    rest = counted.where("digest is not null").join(clash, "digest", "left_anti").withColumn("split", F.lit(0))
    met = counted.join(several, ["digest", "term"]).select(rest.columns)
    groups = counted.where("digest is null").withColumn("split", F.lit(None).cast("int"))
    return groups.unionByName(rest).unionByName(met), strings.unionByName(several.select("digest", "split", "term"))


def _report(counted: DataFrame, scratch: Scratch, least_docs: int, ranks: int) -> DataFrame:
    split, strings = _split_terms(counted, scratch)
    terms = split.where("digest is not null").groupBy("lang", "source", "digest", "split").agg(F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs"))
    whole = W.partitionBy("lang", "digest", "split")
    terms = terms.select("*", F.sum("n_docs").over(whole).alias("all_docs"), F.sum("count").over(whole).alias("total"), (F.col("source") == F.min("source").over(whole)).alias("lead"))
    kept = scratch.hold(terms.where(F.col("all_docs") >= least_docs).drop("n_docs", "all_docs"))

    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"), F.sum(F.col("lead").cast("long")).alias("leads"))
    groups = counted.where("digest is null").select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "terms", "leads"])
    lang = W.partitionBy("lang")
    groups = groups.select("lang", "source", "n", "terms", F.sum("leads").over(lang).alias("v"), F.sum("n").over(lang).alias("lang_n"), F.monotonically_increasing_id().alias("g"))
    # the numbers hold from here on, as the table is written
    groups = scratch.hold(groups).withColumn("z", F.expr(f"CASE WHEN v > 0 THEN {_p('0L', 'n')} END"))
    few = groups.count() <= FEW_GROUPS

    def known(df: DataFrame, on: list[str]) -> DataFrame:
        return df.join(F.broadcast(groups) if few else groups, on)

    weighed = known(kept, ["lang", "source"]).withColumn("p", F.expr(_p("count", "n")))
    return _pairs(weighed, groups, few).unionByName(_terms(weighed, strings, ranks))


def _terms(weighed: DataFrame, strings: DataFrame, ranks: int) -> DataFrame:
    over = weighed.withColumn("q", F.expr(_p("total", "lang_n"))).where("p > q").withColumn("value", F.expr(_f("p", "q")))
    group = W.partitionBy("lang", "source")
    # those of the last value are all kept until their strings tell them apart; tasks hand on no more than that
    best = over.select("lang", "source", "digest", "split", "value", "v", F.rank().over(group.orderBy(F.desc("value"))).alias("place")).where(F.col("place") <= ranks)
    named = best.join(strings, ["digest", "split"]).withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= ranks)
    return named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank", F.col("v").alias("n_terms"))


def _pairs(weighed: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    other = groups.select("lang", *(F.col(c).alias(f"{c}_h") for c in ("source", "g", "z", "terms")))
    other = F.broadcast(other) if few else other
    # where one of the two has no occurrences, only a term's number of occurrences in the other counts
    sizes = weighed.groupBy("lang", "g", "p").agg(F.count("*").alias("m"))
    alone = sizes.join(other, "lang").where("g <> g_h").groupBy("g", "g_h")
    alone = alone.agg(F.sum(F.expr(f"m * ({_f('p', 'z_h')})")).alias("own"), F.sum(F.expr(f"m * ({_f('z_h', 'p')})")).alias("turned"))
    alone = alone.select("g", F.col("g_h").alias("h"), F.col("own").alias("value")).unionByName(alone.select(F.col("g_h").alias("g"), F.col("g").alias("h"), F.col("turned").alias("value")))
    lists = weighed.groupBy("lang", "digest", "split").agg(F.collect_list(F.struct("g", "p", "z")).alias("x")).where("size(x) > 1").select("x")
    both = lists.mapInArrow(_both, "g long, h long, value long")
    added = alone.unionByName(both).groupBy("g", "h").agg(F.sum("value").alias("added"))
    pairs = groups.join(other, "lang").where("g <> g_h").withColumnRenamed("g_h", "h").join(added, ["g", "h"], "left")
    value = F.when(F.col("v") > 0, F.coalesce("added", F.lit(0)) + F.expr(f"(v - terms - terms_h) * ({_f('z', 'z_h')})")).otherwise(F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("source_h").alias("item"), value.cast("long").alias("value"), F.col("v").alias("n_terms"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", "part", "item", "value", rank.alias("rank"), "n_terms")


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For terms that several groups have, what each pair of them adds over the sums for terms that one of the two has."""

    def f(p, q):
        return (p - q) * (p - q) // q

    for batch in batches:
        column = batch.column(0)
        flat = column.flatten()
        n = np.diff(column.offsets.to_numpy())
        # a list's elements follow one another, so each meets those from its list's first on
        first, times = np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)
        g, p, z = (flat.field(i).to_numpy() for i in range(3))
        done, at = np.concatenate([[0], np.cumsum(times)]), 0
        out: list[tuple] = []
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            m = times[at:to]
            left = np.repeat(np.arange(at, to), m)
            right = np.repeat(first[at:to] - (done[at:to] - done[at]), m) + np.arange(m.sum())
            apart = left != right
            left, right = left[apart], right[apart]
            value = f(p[left], p[right]) - f(p[left], z[right]) - f(z[left], p[right]) + f(z[left], z[right])
            out.append(_summed(g[left], g[right], value))
            at = to
        if out:
            sums = _summed(*(np.concatenate(x) for x in zip(*out, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["g", "h", "value"])


def _summed(g: np.ndarray, h: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, at = _runs(h, g)
    return (g[order[at]], h[order[at]], np.add.reduceat(value[order], at)) if len(at) else (g, h, value)
