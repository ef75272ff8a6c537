"""Token files: ids of all documents in order of doc_id, compressed by a grammar per shard (Re-Pair), with random access.

A shard holds the ids of consecutive documents, about SHARD_IDS of them. Its grammar is found in rounds: all pairs of
neighbouring symbols are counted, the frequent ones ranked, and each occurrence that no better-ranked pair overlaps is
replaced by the pair's nonterminal; pairs never reach across documents. Rounds go on while they shorten the shard. What is
stored of a shard:

* index: documents' ids, whether they are null, their numbers of token ids and of symbols;
* grammar: the token id of each terminal, the two symbols of each rule, and how many ids each nonterminal expands to;
* symbols: the documents' symbols, terminals first, then nonterminals.

Numbers are little-endian. A document is decoded from its own symbols, and a range of ids from those symbols that the
expansion lengths show to hold it. Shards are rows of a Parquet table, so that a writer's lost tasks leave nothing behind
and only the columns and shards asked for are read; a second table has the number of ids before each of the writer's parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._graph import checkpoint_folder
from ._tokens import byte_level, vocabulary
from ._words import short_batches, slices

SHARD_IDS = 1 << 20
#: A pair is replaced where it occurs so often in a shard, and rounds go on while one removes this share of the symbols.
LEAST, GAIN = 8, 1 / 16
END = 0
#: Bytes of text that are encoded at a time, or one text.
BATCH_BYTES = 8 << 20
_NONE = np.iinfo(np.int32).max
SHARD = "part int, seq int, before long, n_docs long, n_ids long, index binary, grammar binary, symbols binary"


def _ranked(seq: np.ndarray, open_: np.ndarray, n: int) -> np.ndarray:
    """Rank of each symbol's pair with the next one, the most frequent first; _NONE for rare ones and a document's last."""
    kind = np.uint32 if n < 1 << 16 else np.uint64
    key = seq[:-1].astype(kind) * kind(n) + seq[1:].astype(kind)
    whole = np.sort(key[open_])
    cut = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1], [True]])) if len(whole) else np.zeros(1, np.int64)
    count = np.diff(cut)
    often = np.flatnonzero(count >= LEAST)
    often = often[np.argsort(-count[often], kind="stable")]
    rank = np.full(len(key), _NONE, np.int32)
    if not len(often):
        return rank
    # one slot a pair: of pairs that share a slot the best-ranked has this round, the others a later one
    bits = int(len(often) * 8).bit_length()
    wide, shift = key.itemsize * 8, kind(key.itemsize * 8 - min(bits, 24))
    odd = kind(0x9E3779B97F4A7C15 & ((1 << wide) - 1) | 1)
    best = whole[cut[often]]
    slot_key, slot_rank = np.zeros(1 << min(bits, 24), kind), np.full(1 << min(bits, 24), _NONE, np.int32)
    slot = ((best * odd) >> shift)[::-1]
    slot_key[slot], slot_rank[slot] = best[::-1], np.arange(len(best), dtype=np.int32)[::-1]
    slot = (key * odd) >> shift
    hit = (slot_key[slot] == key) & open_
    rank[hit] = slot_rank[slot[hit]]
    return rank


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Pairs that no better-ranked pair overlaps; of a pair that overlaps itself, every second one."""
    before, after = np.full_like(rank, _NONE), np.full_like(rank, _NONE)
    before[1:], after[:-1] = rank[:-1], rank[1:]
    known = rank < _NONE
    first = rank < before
    again = known & (rank == before)
    if again.any():
        at = np.arange(len(rank))
        first |= again & ((at - np.maximum.accumulate(np.where(again, 0, at))) % 2 == 0)
    return known & first & (rank <= after)


def repair(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, lengths, symbols, symbol ends of documents) of token ids with the ends of documents."""
    seen = np.bincount(ids) > 0
    terminals, seq = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    rules, n = [np.empty((0, 2), np.int32)], len(terminals)
    lengths = np.ones(n, np.int64)
    while len(seq) > 1:
        rank = _ranked(seq, ~last[:-1], n)
        chosen = _chosen(rank)
        uses = np.bincount(rank[chosen]) if chosen.any() else np.empty(0, np.int64)
        kept = uses >= LEAST // 2
        if not kept.any():
            break
        chosen[chosen] = kept[rank[chosen]]
        at = np.flatnonzero(chosen)
        name = np.cumsum(kept) - 1
        rule = np.empty((int(kept.sum()), 2), np.int32)
        of = name[rank[at]]
        rule[of, 0], rule[of, 1] = seq[at], seq[at + 1]
        rules.append(rule)
        lengths = np.concatenate([lengths, lengths[rule[:, 0]] + lengths[rule[:, 1]]])
        seq[at] = n + of
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last, n = seq[stay], last[stay], n + len(rule)
        if len(at) < GAIN * len(seq):
            break
    return terminals, np.concatenate(rules), lengths, seq, np.flatnonzero(last) + 1


def expand(symbols: np.ndarray, terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Token ids of symbols: those of the nonterminals among them, one level of rules at a time, then all in one go."""
    n = len(terminals)
    used = np.flatnonzero(np.bincount(symbols, minlength=len(lengths)))
    seq = used
    while (wide := seq >= n).any():
        at = np.cumsum(1 + wide) - 1 - wide
        out = np.empty(len(seq) + int(wide.sum()), seq.dtype)
        left, right = rules[seq[wide] - n].T
        out[at[~wide]] = seq[~wide]
        out[at[wide]], out[at[wide] + 1] = left, right
        seq = out
    first = np.zeros(len(lengths), np.int64)
    first[used] = np.cumsum(lengths[used]) - lengths[used]
    size = lengths[symbols]
    off = np.cumsum(size) - size
    return terminals[seq[np.repeat(first[symbols] - off, size) + np.arange(size.sum())]]


def expand_range(symbols: np.ndarray, terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, n: int) -> np.ndarray:
    """n token ids from start on, of what the symbols expand to; only symbols that hold some of them are expanded."""
    upto = np.cumsum(lengths[symbols])
    lo, hi = np.searchsorted(upto, start, "right"), np.searchsorted(upto, start + n, "left") + 1
    skip = start - (int(upto[lo - 1]) if lo else 0)
    return expand(symbols[lo:hi], terminals, rules, lengths)[skip : skip + n]


def _narrow(x: np.ndarray) -> bytes:
    """x with its width in front: 2 bytes a number where they do, else 4."""
    width = 2 if not len(x) or x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int32)


def pack_shard(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """index, grammar and symbols of a shard."""
    terminals, rules, lengths, symbols, cut = repair(ids, ends)
    sizes = [np.diff(x, prepend=0).astype("<u4").tobytes() for x in (ends, cut)]
    index = b"".join([np.array([len(doc_ids)], "<i8").tobytes(), doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), *sizes])
    head = np.array([len(terminals), len(rules)], "<i8").tobytes()
    return index, head + terminals.astype("<u4").tobytes() + rules.astype("<u4").tobytes() + lengths[len(terminals) :].astype("<u4").tobytes(), _narrow(symbols)


def read_index(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether they are null, and the documents' numbers of ids and of symbols."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    return np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, np.uint8, n, 8 + 8 * n).astype(bool), *(np.frombuffer(blob, "<u4", n, 8 + (9 + 4 * i) * n).astype(np.int64) for i in (0, 1))


def read_grammar(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terminals, rules and expansion lengths of all symbols."""
    n, m = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    terminals = np.frombuffer(blob, "<u4", n, 16)
    rules = np.frombuffer(blob, "<u4", 2 * m, 16 + 4 * n).astype(np.int32).reshape(m, 2)
    return terminals, rules, np.concatenate([np.ones(n, np.int64), np.frombuffer(blob, "<u4", m, 16 + 4 * n + 8 * m).astype(np.int64)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of docs' texts, each document's followed by END, below path.

    Documents go in ascending order of doc_id, rows that share one by a hash of their text, rows without one last; every
    row is a document, a null or empty one of END alone. tokenizer is a file of the tokenizers library, by default the
    public byte-level vocabulary of 50k; it is read on the driver (some megabytes). Special tokens are not added. Other
    columns are ignored. An empty table gives tables without rows. A document is never cut: a very long one makes a shard
    of its own size. Which rows a task gets follows from ranges of the order, in which the place of a row is the last
    part, so that rows alike don't meet in one task.
    """
    spark = docs.sparkSession
    with open(tokenizer or vocabulary("byte_bpe_50k.json"), "rb") as f:
        source = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_level(source.value, False), TaskContext.get().partitionId()
        held: list[tuple] = []
        before = seq = size = 0

        def shard():
            doc_ids, null, ids = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            ends = np.cumsum(np.concatenate([x[3] for x in held]))
            blobs = pack_shard(doc_ids, null, ids, ends)
            values = [part, seq, before, len(doc_ids), len(ids), *blobs]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in SHARD.split(", ")])

        for piece, data, off in slices(batches, limit=BATCH_BYTES):
            ids, cut = encoder.ids(data, off)
            count = np.diff(cut) + 1
            ends = np.cumsum(count)
            whole = np.full(len(ids) + len(count), END, np.int32)
            at = np.ones(len(whole), bool)
            at[ends - 1] = False
            whole[at] = ids
            names, null = piece.column(0).fill_null(0).to_numpy(), piece.column(0).is_null().to_numpy(zero_copy_only=False)
            lo = done = 0
            while lo < len(count):
                # documents until the shard is full
                hi = min(int(np.searchsorted(ends, done + shard_ids - size)) + 1, len(count))
                held.append((names[lo:hi], null[lo:hi], whole[done : ends[hi - 1]], count[lo:hi]))
                size += int(ends[hi - 1]) - done
                lo, done = hi, int(ends[hi - 1])
                if size >= shard_ids:
                    yield shard()
                    before, seq, size = before + size, seq + 1, 0
                    held.clear()
        if held:
            yield shard()

    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), "h", "row").select("doc_id", "text")
    rows.mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    parts.write.parquet(f"{path}/parts")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards' rows, with first: the number of ids before the shard."""
    return spark.read.parquet(f"{path}/shards").join(spark.read.parquet(f"{path}/parts"), "part").withColumn("first", F.col("first") + F.col("before"))


def decode(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with END) and ids (binary, little-endian unsigned 32 bits
    each) of every document below path."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, index, grammar, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, null, count, _ = read_index(index)
                raw = expand(_wide(symbols), *read_grammar(grammar)).astype("<u4")
                ends = np.cumsum(count)
                for lo in range(0, len(count), 1024):
                    hi = min(lo + 1024, len(count))
                    off = np.concatenate([[0], np.cumsum(count[lo:hi])]) * 4
                    data = raw[ends[lo] - count[lo] : ends[hi - 1]]
                    blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[lo:hi], mask=null[lo:hi]), pa.array(first + ends[lo:hi] - count[lo:hi]), pa.array(count[lo:hi]), blob.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
                    )

    return read_shards(spark, path).select("first", "index", "grammar", "symbols").mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """request, ids (binary as in decode) for each row (request, start, n) of wanted: n ids from the start-th of all.

    Requests meet their shards by equality of blocks of shard_ids ids, and only the symbols that hold the ids are expanded.
    What lies before the first id or beyond the last is left out; a request without any id gives no row."""
    shards = read_shards(spark, path).withColumn("block", F.explode(F.expr(f"sequence(first div {shard_ids}, (first + n_ids - 1) div {shard_ids})")))
    asked = wanted.select("request", F.greatest(F.col("start").cast("long"), F.lit(0)).alias("lo"), (F.col("start") + F.col("n")).cast("long").alias("hi")).where("lo < hi")
    asked = asked.withColumn("block", F.explode(F.expr(f"sequence(lo div {shard_ids}, (hi - 1) div {shard_ids})")))
    met = asked.join(shards, "block").where("lo < first + n_ids and first < hi")
    # a request and a shard that share several blocks meet in the first of them
    met = met.where(f"block = greatest(lo, first) div {shard_ids}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for request, lo, hi, first, n_ids, grammar, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terminals, rules, lengths = read_grammar(grammar)
                at = max(lo - first, 0)
                got = expand_range(_wide(symbols), terminals, rules, lengths, at, min(hi - first, n_ids) - at)
                yield pa.RecordBatch.from_arrays([pa.array([request], batch.schema.field(0).type), pa.array([first]), pa.array([got.astype("<u4").tobytes()])], ["request", "first", "ids"])

    kind = dict(wanted.dtypes)["request"]
    parts = met.select("request", "lo", "hi", "first", "n_ids", "grammar", "symbols").mapInArrow(each, f"request {kind}, first long, ids binary")
    pieces = parts.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("first", "ids"))).alias("x"))
    return pieces.select("request", F.expr("aggregate(x, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def new_folder(docs: DataFrame) -> str:
    """A folder of its own below the checkpoint folder."""
    return f"{checkpoint_folder(docs)}/tokens-{uuid.uuid4().hex}"
