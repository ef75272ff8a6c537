"""Alignment of two tokenizers over each text, in Arrow columns.

Both tokenizers' ids of a batch are list columns; their flattened values, parent indices and cumulative byte lengths give
each token's document and end. Ends of both that are equal by a hash join on (document, end) cut a document into groups.
The distinct ends of both are the stretches that one token of each kind covers together, so they list the links, each
once. Links of a document are counted by id pair with a grouped table, written, and the numbers of documents of each pair
are partial counts of batches that Spark adds up.

Pairs that many documents hold are at most HOT, as each has at least that share of all; their counts go to every task.
The counts of other pairs are joined by the pair, of which no one has more than that share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import Scratch, checkpointed
from ._tokens import byte_level, piece_level, vocabulary
from ._words import short_batches, slices

#: A pair is hot when it has more than 1 / HOT of all documents' pairs.
HOT = 1 << 17
#: Bytes of text that are aligned at a time, or one text.
PIECE_BYTES = 1 << 18
#: An id pair as one number: first id times this, plus the second.
SHIFT = 1 << 24


@lru_cache(1)
def byte_lengths(source: bytes) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id of a byte-level vocabulary file, and their numbers. Its characters stand for bytes: visible ones of
    the first 256 for themselves, the others, in order, for those from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocabulary = Tokenizer.from_buffer(source).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        out[i] = bytes(table[c] for c in name)
    return out, np.array([len(x) for x in out])


@lru_cache(1)
def piece_lengths(source: bytes) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id of a sentencepiece model, and their numbers: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=source)
    ids = range(model.get_piece_size())
    out = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in ids)]
    return out, np.array([len(x) for x in out])


def _list(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int32()))


def _ends(tokens: pa.ListArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, documents and ends (bytes from the document's first on) of a list column's tokens."""
    ids, doc = tokens.flatten().to_numpy(), pc.list_parent_indices(tokens).to_numpy()
    total = pc.cumulative_sum(pa.array(size[ids], pa.int64())).to_numpy() if len(ids) else np.empty(0, np.int64)
    # the sum before a document's first token is taken off
    first = tokens.offsets.to_numpy()[:-1]
    before = np.concatenate([[0], total])[first]
    return ids, doc, total - before[doc]


def _same_bytes(tokens: pa.ListArray, table: pa.Array, size: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each document's tokens, joined, are its text."""
    ids, cut = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()
    length = np.concatenate([[0], np.cumsum(size[ids])])[cut]
    # an Arrow column's values lie one after the other
    joined = table.take(pa.array(ids)).buffers()[2] if len(ids) else None
    raw = np.frombuffer(joined, np.uint8, length[-1]) if joined else np.empty(0, np.uint8)
    same = np.diff(length) == np.diff(off)
    if len(raw) == len(data) and same.all():
        differs = np.concatenate([[0], np.cumsum(raw != data)])
        return differs[off[1:]] == differs[off[:-1]]
    for d in np.flatnonzero(same):
        same[d] = np.array_equal(raw[length[d] : length[d + 1]], data[off[d] : off[d + 1]])
    return same


def align(tokens_a: pa.ListArray, tokens_b: pa.ListArray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, pa.ChunkedArray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of documents whose tokens of both kinds join to the same bytes: their numbers of groups, the groups as strings
    `a1,a2|b1;a3|b2,b3`, and all links as (document, id of the first kind, id of the second)."""
    n = len(tokens_a)
    a, doc_a, end_a = _ends(tokens_a, size_a)
    b, doc_b, end_b = _ends(tokens_b, size_b)
    left = pa.table({"doc": doc_a, "end": end_a, "i": np.arange(len(a))})
    right = pa.table({"doc": doc_b, "end": end_b, "j": np.arange(len(b))})
    met = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    order = np.argsort(met.column("i").to_numpy())
    last_a, last_b = met.column("i").to_numpy()[order], met.column("j").to_numpy()[order]
    n_groups = np.bincount(doc_a[last_a], minlength=n)

    # tokens in the order of the strings: by group, then kind; each with the mark that follows it
    group_a = np.searchsorted(last_a, np.arange(len(a)))
    group_b = np.searchsorted(last_b, np.arange(len(b)))
    group = np.concatenate([group_a, group_b])
    kind = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    order = np.argsort(group * 2 + kind, kind="stable")
    mark = np.zeros(len(order), np.int8)
    mark[last_a] = 1
    mark[len(a) + last_b] = 2
    # a document's last token has none
    final = np.flatnonzero(np.diff(tokens_b.offsets.to_numpy()) > 0)
    mark[len(a) + tokens_b.offsets.to_numpy()[final + 1] - 1] = 3
    name = pc.cast(pa.array(np.concatenate([a, b])[order]), pa.string())
    pieces = pc.binary_join_element_wise(name, pa.array([",", "|", ";", ""]).take(pa.array(mark[order])), "")
    cut = tokens_a.offsets.to_numpy() + tokens_b.offsets.to_numpy()
    strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pieces), "")

    # each distinct end of either kind closes a stretch of one token of each kind: the first that ends there or later
    shift = np.int64(max(end_a.max(), end_b.max()) + 1) if len(a) else np.int64(1)
    at = np.concatenate([doc_a * shift + end_a, doc_b * shift + end_b])
    order = np.argsort(at, kind="stable")
    at, of_a = at[order], order < len(a)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    ended = np.cumsum(of_a) - of_a
    i, j = ended[new], (np.arange(len(at)) - ended)[new]
    return n_groups, strings, (doc_a[i], a[i], b[j])


def aligned(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None, digest: bool = False) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups (the string, '' without tokens; with digest
    its SHA-256 in lower-case hex instead), and of each
    distinct linked id pair its number (first id * SHIFT + second) in pairs and how often it is linked in times."""
    spark = docs.sparkSession
    sources = []
    for file in (byte_file or vocabulary("byte_bpe_50k.json"), piece_file or vocabulary("piece_bpe_32k.model")):
        with open(file, "rb") as f:
            sources.append(spark.sparkContext.broadcast(f.read()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source_a, source_b = (x.value for x in sources)
        encoders = byte_level(source_a, True, 4), piece_level(source_b, 4)
        (bytes_a, size_a), (bytes_b, size_b) = byte_lengths(source_a), piece_lengths(source_b)
        tables = [(pa.array(x, pa.binary()), n) for x, n in ((bytes_a, size_a), (bytes_b, size_b))]
        for piece, data, off in slices(batches, limit=PIECE_BYTES):
            count = np.diff(off)
            # a space in front of each text that is not empty
            some = count > 0
            spaced = np.concatenate([[0], np.cumsum(count + some)])
            whole = np.full(spaced[-1], 32, np.uint8)
            inside = np.ones(len(whole), bool)
            inside[spaced[:-1][some]] = False
            whole[inside] = data
            lists = [_list(*e.ids(whole, spaced)) for e in encoders]
            good = some.copy()
            for tokens, (table, size) in zip(lists, tables, strict=True):
                good &= _same_bytes(tokens, table, size, whole, spaced)
            # others have no tokens
            lists = [pc.if_else(pa.array(good), x, pa.scalar([], x.type)) if not good.all() else x for x in lists]
            lists = [_list(x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())])) for x in lists]
            n_groups, groups, (doc, a, b) = align(*lists, size_a, size_b)
            if digest:
                groups = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups.to_pylist()], pa.string())
            links = pa.table({"doc": doc, "pair": a.astype(np.int64) * SHIFT + b, "one": np.ones(len(doc), np.int32)})
            links = links.group_by(["doc", "pair"], use_threads=False).aggregate([("one", "sum")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
            cut = pa.array(np.searchsorted(links.column("doc").to_numpy(), np.arange(len(good) + 1)), pa.int32())
            n_a, n_b = (pc.list_value_length(x).cast(pa.int64()) for x in lists)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), n_a, n_b, pa.array(n_groups, pa.int64()), pa.array(np.bincount(doc, minlength=len(good)), pa.int64()), groups,
                 pa.ListArray.from_arrays(cut, links.column("pair").combine_chunks()), pa.ListArray.from_arrays(cut, links.column("one_sum").combine_chunks().cast(pa.int32()))],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )

    rows = short_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(each, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = pa.table({"pair": batch.column(0).flatten()}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        yield from got.rename_columns(["pair", "held"]).combine_chunks().to_batches()


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, held (number of rows of aligned() that have it linked) and best (whether no other pair of its first id has more)."""
    counts = links.select("pairs").mapInArrow(_partial_counts, "pair long, held long").groupBy("pair").agg(F.sum("held").alias("held"))
    own = W.partitionBy(F.expr(f"pair div {SHIFT}"))
    return counts.select("pair", "held", (F.col("held") == F.max("held").over(own)).alias("best"))


def alignment_report(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by the most documents of all pairs of its first
    id, ties included), count_sum (over links, how many documents hold their pair) and groups_sha256 for every row of docs.

    Texts are read with a space in front, special tokens' strings as plain text. A document whose text is null or empty, or
    whose joined token bytes of either kind are not space and text, has no tokens: zeros, and '' for groups_sha256. Every
    row is a document, also rows without doc_id or with a shared one. Other columns are ignored. An empty table gives an
    empty result. The two files (by default the public vocabularies) are read on the driver; a very long text is one piece
    of work in its own task.
    """
    with Scratch(docs) as scratch:
        found = scratch.hold(aligned(docs, byte_file, piece_file, True))
        counts = scratch.hold(pair_counts(found))
        total = counts.agg(F.sum("held")).first()[0] or 0
        hot = counts.where(F.col("held") > total // HOT).toPandas().sort_values("pair")
        known = docs.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "held", "best")))

        def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, held, best = known.value
            table = pa.table({"pair": pair, "held": held, "best": best.astype(np.int64)})
            for batch in batches:
                links = pa.table({"doc": pc.list_parent_indices(batch.column(1)).cast(pa.int64()), "pair": batch.column(1).flatten(), "times": batch.column(2).flatten().cast(pa.int64())})
                met = links.join(table, "pair", join_type="inner", use_threads=False)
                met = met.append_column("n", pc.multiply(met.column("times"), met.column("held"))).append_column("b", pc.multiply(met.column("times"), met.column("best")))
                sums = met.group_by("doc", use_threads=False).aggregate([("n", "sum"), ("b", "sum")])
                out = np.zeros((2, batch.num_rows), np.int64)
                at = sums.column("doc").to_numpy()
                out[0, at], out[1, at] = sums.column("n_sum").to_numpy(), sums.column("b_sum").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1])], ["row", "count_sum", "n_best"])

        def cold_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = pa.array(known.value[0], pa.int64())
            for batch in batches:
                flat = batch.column(1).flatten()
                cold = pc.invert(pc.is_in(flat, pair))
                row = batch.column(0).take(pc.list_parent_indices(batch.column(1)))
                yield pa.RecordBatch.from_arrays([row.filter(cold), flat.filter(cold), batch.column(2).flatten().filter(cold)], ["row", "pair", "times"])

        links = found.select("row", "pairs", "times")
        sums = links.mapInArrow(hot_sums, "row long, count_sum long, n_best long")
        cold = links.mapInArrow(cold_links, "row long, pair long, times int").join(counts.where(F.col("held") <= total // HOT), "pair")
        cold = cold.select("row", (F.col("times") * F.col("held")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).cast("long").alias("n_best"))
        sums = sums.unionByName(cold).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
        out = found.drop("pairs", "times").join(sums, "row")
        return checkpointed(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")))
