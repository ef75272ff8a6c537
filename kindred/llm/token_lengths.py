"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import checkpointed
from ._words import short_batches, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies split a text before merging (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that is long enough to be encoded by itself; the characters are those of \s in PATTERN.
LONG_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}"
CHUNK = 1024


def pieces(text: str):
    """(part of the text, whether it is one run of white space to be merged as a whole): PATTERN splits there as well, as
    all of a run but its last character is one piece, and the last one goes with what follows. Encoding the parts one by
    one gives the same tokens and spares the pattern's search, which gives up on very long runs."""
    at = 0
    for m in re.finditer(LONG_SPACE, text):
        end = m.end() - (m.end() < len(text))
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row, by the byte-level vocabulary in that file of ranks; null and empty texts have 0.

    Texts are encoded whole, a few megabytes or one text at a time, also where they hold very long white space. Rows that
    share a doc_id are returned one by one; other columns are ignored; an empty table gives an empty result. The file
    (about 1 MB, fixed) is read once on the driver and broadcast."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        whole = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=table, special_tokens={})
        for piece, _, _ in slices(batches):
            n = [sum(len((whole if space else own).encode_to_numpy(p, disallowed_special=())) for p, space in pieces(t) if p) if t else 0 for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long")


def length_report(lengths: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: n_docs of that length, docs_up_to and docs_over it, the
    tokens_up_to it (of documents that fit), truncated_tokens (of all documents, cut to the limit), share_up_to (the
    quantile that the limit is) and total_tokens.

    The histogram is a grouped count, checkpointed, so that texts are encoded once. Its running sums go chunk by chunk of CHUNK lengths, so no task holds it whole. Rows
    without n_tokens are left out; an empty table gives an empty result.
    """
    bins = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    bins = checkpointed(bins)
    bins = bins.withColumn("chunk", F.floor(F.col("n_tokens") / CHUNK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    chunks = bins.groupBy("chunk").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before, whole = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    chunks = chunks.select(
        "chunk", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt")
    )
    within = W.partitionBy("chunk").orderBy("n_tokens")
    out = bins.join(chunks, "chunk").withColumn("docs_up_to", F.col("d_before") + F.sum("n_docs").over(within)).withColumn("tokens_up_to", F.col("t_before") + F.sum("tokens").over(within))
    over = F.col("d_all") - F.col("docs_up_to")
    return out.select(
        "n_tokens", "n_docs", "docs_up_to", over.alias("docs_over"), "tokens_up_to", (F.col("tokens_up_to") + over * F.col("n_tokens")).alias("truncated_tokens"), (F.col("docs_up_to") / F.col("d_all")).alias("share_up_to"), F.col("t_all").alias("total_tokens")
    )


def at_limits(report: DataFrame, limits: DataFrame) -> DataFrame:
    """limit and the same numbers as in length_report for every row of limits (limit), also for limits that no document's
    length is: what fits and what is cut follows from the longest length up to the limit. A limit below all lengths fits
    none; null limits are left out, repeated ones returned once each. Without documents there are no rows.

    Limits meet the report's rows in one order of both, chunk by chunk of CHUNK lengths; a chunk's last row is carried on."""
    named = ["docs_up_to", "tokens_up_to", "docs_over", "total_tokens"]
    last = F.struct("n_tokens", *named)
    rows = report.select(F.col("n_tokens").alias("at"), F.lit(0).alias("turn"), last.alias("row"))
    asked = limits.where("limit is not null").select(F.col("limit").cast("long").alias("at"), F.lit(1).alias("turn"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = rows.unionByName(asked).withColumn("chunk", F.floor(F.col("at") / CHUNK))
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = both.groupBy("chunk").agg(F.max("row").alias("top")).select("chunk", F.last("top", ignorenulls=True).over(before).alias("carried"))
    within = W.partitionBy("chunk").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn("near", F.last("row", ignorenulls=True).over(within)).where("turn = 1").join(chunks, "chunk").withColumn("row", F.coalesce("near", "carried"))
    whole = report.agg(F.max("total_tokens").alias("all_tokens"), F.max(F.col("docs_up_to") + F.col("docs_over")).alias("all_docs")).where("all_docs is not null")
    out = met.join(F.broadcast(whole))
    fits, over = F.coalesce("row.docs_up_to", F.lit(0)), F.coalesce("row.docs_over", F.col("all_docs"))
    tokens = F.coalesce("row.tokens_up_to", F.lit(0))
    return out.select(
        F.col("at").alias("limit"), fits.alias("docs_up_to"), over.alias("docs_over"), tokens.alias("tokens_up_to"), (tokens + over * F.greatest("at", F.lit(0))).alias("truncated_tokens"), (fits / F.col("all_docs")).alias("share_up_to"), F.col("all_tokens").alias("total_tokens")
    )


def quantile_lengths(report: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens, the least length that at least that share of documents does not exceed, for each of the shares (0
    to 1). Without documents there are no rows."""
    at = F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share")
    return report.select("n_tokens", "share_up_to", at).where("share_up_to >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
