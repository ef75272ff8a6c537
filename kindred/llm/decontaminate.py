"""Benchmark decontamination as a prefix-filtered set join.

Each window of item words must be contained whole in a document, so one of its shingles is a sufficient prefix: the
rarest, by counts over the whole corpus. Documents are scanned for these shingles only. A hit joins the windows of that
shingle, is held against length and position (the window must fit into the document where the shingle lies) and is then
compared word by word.

Shingle hashes of the items go to the tasks in blocks of at most BLOCK, one scan for each block, so that what is sent has
a fixed bound whatever the items' number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import Scratch, checkpointed
from ._words import mix, runs, short_batches, slices, word_column, words

GRAM = 3
BLOCK = 1_000_000
#: Windows that a row batch holds.
WINDOWS = 4096


def _grams(w, k: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = runs(w.hash, w.doc, k)
    return mix(h, 40 + k), at


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, words and grams (numbers, in order of place) of every window of the items, a few thousand windows at a time
    however long an item is."""

    def split(batches):
        for piece, data, off in slices(batches):
            w = words(data, off, lower=True, alnum=True)
            cut, column = w.bounds(), word_column(w).cast(pa.string())
            by_size = {k: _grams(w, k) for k in range(1, GRAM + 1)}
            for i, name in enumerate(piece.column(0)):
                a, n = int(cut[i]), int(cut[i + 1] - cut[i])
                if not n:
                    continue
                size = min(window, n)
                gram = min(GRAM, size)
                h, at = by_size[gram]
                # a text's grams follow one another
                h = h[np.searchsorted(at, a) :].view(np.int64)
                for lo in range(0, n - size + 1, WINDOWS):
                    first = np.arange(lo, min(lo + WINDOWS, n - size + 1))
                    own = column.take(pa.array((a + first[:, None] + np.arange(size)).ravel()))
                    grams = pa.array(h[(first[:, None] + np.arange(size - gram + 1)).ravel()])
                    steps = np.arange(len(first) + 1, dtype=np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(steps * np.int32(len(x) // len(first))), x) for x in (own, grams)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(first), pa.string()), *lists], ["item_id", "words", "grams"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(split, "item_id string, words array<string>, grams array<long>")


def _found(w, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wanted grams (ascending) in some texts, and the word at which each begins."""
    grams, places = [], []
    for k in range(1, GRAM + 1):
        h, at = _grams(w, k)
        h = h.view(np.int64)
        i = np.searchsorted(wanted, h)
        hit = wanted[np.minimum(i, len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
        grams.append(h[hit])
        places.append(at[hit])
    return np.concatenate(grams), np.concatenate(places)


def _blocks(grams: DataFrame) -> list[np.ndarray]:
    """The distinct grams in ascending blocks of at most BLOCK."""
    n = grams.select("gram").distinct().count()
    count = max(1, -(-n // (BLOCK // 2)))
    if count == 1:
        yield np.sort(grams.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)) if n else np.empty(0, np.int64)
        return
    for b in range(count):
        part = grams.select("gram").distinct().where(F.pmod(F.xxhash64("gram"), F.lit(count)) == b)
        yield np.sort(part.toPandas()["gram"].to_numpy(np.int64))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item_ids as strings, sorted), spans (array of first word and length of each
    occurrence of a window) and contaminated for every document.

    Words are runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z. A window is that many consecutive words
    of an item; an item of fewer words, but not none, is one window. A document's word inside an occurrence of a window is
    hit. Null and empty texts have no words; items without text have no windows. Items without item_id hit words, but are
    not among a document's items. Repeated items count once by item_id. Rows that share a doc_id give one row: the most words, and the hits of all of them. Rows without a doc_id are
    left out. Other columns are ignored. Empty tables give an empty result or no hits.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    with Scratch(docs) as scratch:
        return checkpointed(_hits(docs, items, window, scratch))


def _counter(wanted: np.ndarray):
    def count(batches):
        total = np.zeros(len(wanted), np.int64)
        for _, data, off in slices(batches):
            g, _ = _found(words(data, off, lower=True, alnum=True), wanted)
            total += np.bincount(np.searchsorted(wanted, g), minlength=len(wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen]), pa.array(total[seen])], ["gram", "seen"])

    return count


def _scanner(wanted: np.ndarray, window: int, summary: bool):
    """A row for each wanted gram of a text, with the words around it, and with summary one a text for its size."""
    names = ["doc_id", "n_words", "gram", "before", "at", "context"]

    def scan(batches):
        for piece, data, off in slices(batches):
            w = words(data, off, lower=True, alnum=True)
            g, at = _found(w, wanted)
            cut = w.bounds()
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            doc = w.doc[at]
            lo = np.maximum(at - window + 1, cut[doc])
            hi = np.minimum(at + window, cut[doc + 1])
            context = [[w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.nulls(len(g), pa.int64()), pa.array(g, pa.int64()), pa.array(at - lo, pa.int32()), pa.array(at - cut[doc]), pa.array(context, pa.list_(pa.string()))], names)
            if summary:
                m = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(cut)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.string()))], names)

    return scan


def _hits(docs: DataFrame, items: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    windows = scratch.hold(item_windows(items, window).withColumn("window", F.monotonically_increasing_id()))
    grams = windows.select("window", F.posexplode("grams").alias("place", "gram"))
    counts = None
    for wanted in _blocks(grams):
        part = docs.select("text").mapInArrow(_counter(wanted), "gram long, seen long")
        counts = part if counts is None else counts.unionByName(part)
    rarity = counts.groupBy("gram").agg(F.sum("seen").alias("seen"))
    # a window with a shingle that no document has cannot occur
    ranked = grams.join(rarity, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    chosen = ranked.groupBy("window").agg(F.min(F.struct("seen", "gram", "place")).alias("best")).where("best.seen > 0")
    chosen = scratch.hold(windows.join(chosen, "window").select("item_id", "words", "best.gram", "best.place"))
    # what occurs is compared once for all items that have it, under a number
    probes = scratch.hold(chosen.groupBy("words", "gram", "place").count().select("words", "gram", "place", F.monotonically_increasing_id().alias("number")))
    owners = chosen.join(probes, ["words", "gram", "place"]).select("number", "item_id")
    rows = None
    for wanted in _blocks(probes):
        part = docs.mapInArrow(_scanner(wanted, window, rows is None), "doc_id long, n_words long, gram long, before int, at long, context array<string>")
        rows = part if rows is None else rows.unionByName(part)
    rows = scratch.hold(rows)
    size = F.size("words")
    fits = (F.col("before") >= F.col("place")) & (F.col("before") - F.col("place") + size <= F.size("context"))
    same = F.when(fits, F.slice("context", F.greatest(F.col("before") - F.col("place"), F.lit(0)) + 1, F.greatest(size, F.lit(1))) == F.col("words"))
    met = rows.where("gram is not null").join(probes, "gram").where(same)
    met = met.select("doc_id", F.struct((F.col("at") - F.col("place")).alias("first"), size.cast("long").alias("length")).alias("span"), "number")
    named = met.select("doc_id", "number").distinct().join(owners, "number").select("doc_id", "item_id").distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("span", "struct<first:bigint,length:bigint>"), ("item_id", "string"))]
    each = rows.where("n_words is not null").select("doc_id", "n_words", *none[1:]).unionByName(met.select("doc_id", none[0], "span", none[2])).unionByName(named.select("doc_id", *none[:2], "item_id"))
    total = each.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    # spans are in order: a word counts where no earlier span has reached
    step = F.expr(
        "aggregate(spans, struct(0L as n, 0L as reach), (a, s) -> struct("
        "a.n + greatest(0L, s.first + s.length - greatest(a.reach, s.first)) as n, greatest(a.reach, s.first + s.length) as reach), a -> a.n)"
    )
    return total.select("doc_id", "n_words", step.alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))
