"""N-gram Jaccard self-join by parity sketches.

Two texts link when the Jaccard similarity of their sets of k-word shingles is at least p percent. Texts of the same words
in the same order, by 128 bits of a cryptographic hash, form a class; one representative of each class takes part in the
join.

A set of shingles is hashed into a parity sketch: each shingle flips one cell, so the Hamming distance of two sketches is
at most the size d of the sets' symmetric difference, and linked sets of which the smaller has n shingles have
d <= n * (100 - p) / p. The sketch is cut into blocks, their number fixed for each band of set sizes as D + 1 + s, D
being the largest such d in the band. At most D blocks of two linked sets differ, so s + 1 blocks or more agree
(pigeonhole). Each block is joined by the XOR of its shingles' hashes. Empty blocks say nothing; s is a little more than
the number of them to expect, and a set with more than s empty blocks joins by its empty blocks as well, so no link is
lost. A set joins in its own band, and in each smaller one that has a set which the limit can reach.

Candidates pass a second parity sketch (512 bits, the Hamming bound again), then an exact comparison of the texts'
shingles: those whose hashes agree are compared word by word. A block shared by many sets is not expanded into pairs: its members are compared with its first member, linked
sets are contracted to components, then each set is compared with its nearest of another component, and at last all pairs
still across components are. Blocks of more than TILE members are compared tile by tile. What three or more sets of a
task's batch share is compared and listed there, and only the first of them goes on to meet those of other batches, so a
block that a third of all sets share reaches its task once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import Scratch, checkpointed, components
from ._words import mix, runs, same_words, shingle_sets, short_batches, slices, text_buffer, text_names, words

TILE = 2048
#: Members of blocks that one task compares.
PART_ROWS = 20_000
#: Bits of the filter that keeps texts that are surely not wanted from being dealt out, in 2 ** 15 at a time.
FILTER_CHUNKS = 1 << 9
#: Keys that one task holds at a time.
GROUP_KEYS = 1_000_000
SKETCH_BITS = 512
#: Pairs or members that one row of packed arrays holds.
ROW_ENTRIES = 16_384


def bands(percent: int, largest: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, blocks, s) of each band of set sizes; sets that can't differ are one block."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}, not between 1 and 100")
    out, lo = [], 1
    while lo < largest:
        hi = max(lo, lo * 4 // 3)
        most = hi * (100 - percent) // percent
        spare, blocks = 0, most + 1
        if most >= 7:
            empty = (most + 1) * np.exp(-lo / (most + 1))
            spare = int(np.ceil(empty + 3 * np.sqrt(empty)))
            blocks += spare
        out.append((lo, hi, blocks, spare))
        lo = hi + 1
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for piece, data, off in slices(batches):
        w = words(data, off, lower=True)
        h, cut = shingle_sets(w, k)
        names = text_names(w, off)
        yield piece.column(piece.schema.get_field_index("doc_id")), h, cut, np.diff(cut), names[:, 0].copy(), names[:, 1].copy()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size, 128-bit name of the words and 512-bit parity sketch of the set of every row."""

    def sign(batches):
        for ids, h, cut, n, fp1, fp2 in _sets(batches, k):
            at = np.repeat(np.arange(len(n)), n) * SKETCH_BITS + (mix(h, 15) % np.uint64(SKETCH_BITS)).astype(np.int64)
            bits = np.bincount(at, minlength=len(n) * SKETCH_BITS) & 1
            packed = np.packbits(bits.astype(np.uint8).reshape(len(n), SKETCH_BITS), axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array([x.tobytes() for x in packed], pa.binary())],
                ["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary")


def block_keys(h: np.ndarray, cut: np.ndarray, n: np.ndarray, cls: np.ndarray, plan: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets (ascending hashes h between cuts) and the class of each key."""
    lows = np.array([b[0] for b in plan])
    own = np.searchsorted(lows, n, "right") - 1
    token = mix(h, 16)
    keys, owners = [], []
    highs = np.array([b[1] for b in plan])
    for shift in range(len(plan)):
        chosen = (n > 0) & (own >= shift)
        if shift:
            chosen[chosen] = n[chosen] * percent <= 100 * highs[own[chosen] - shift]
        if not chosen.any():
            break
        for band in np.unique(own[chosen]):
            rows = np.flatnonzero(chosen & (own == band))
            _, _, blocks, spare = plan[band - shift]
            take = np.concatenate([np.arange(cut[r], cut[r + 1]) for r in rows])
            row = np.repeat(np.arange(len(rows)), n[rows])
            # ascending hashes make ascending blocks, so no sort is needed
            block = ((h[take] >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            place = row.astype(np.uint64) * np.uint64(blocks) + block
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            salt = np.uint64((band - shift) * 2 + 1)
            keys.append(mix(np.bitwise_xor.reduceat(token[take], first) ^ mix(block[first] * np.uint64(4096) + salt, 17), 18))
            owners.append(cls[rows[row[first]]])
            full = np.bincount(row[first], minlength=len(rows))
            for r in np.flatnonzero(blocks - full > spare):
                used = np.zeros(blocks, bool)
                used[block[take_range(row, r)].astype(np.int64)] = True
                empty = np.flatnonzero(~used).astype(np.uint64)
                keys.append(mix(mix(empty * np.uint64(4096) + salt, 19), 18))
                owners.append(np.full(len(empty), cls[rows[r]]))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def take_range(row: np.ndarray, r: int) -> slice:
    return slice(*np.searchsorted(row, [r, r + 1]))


def _candidates(docs: DataFrame, k: int, percent: int, groups: int) -> DataFrame:
    """Packed arrays: pairs (a, b) of a block's first class with its others, and members (keys, owners) of blocks of three
    or more."""
    plan, spread = bands(percent), 4 * groups + 16

    def emit(batches):
        held, size = [], 0
        for _, h, cut, n, fp1, _ in _sets(batches, k):
            cls = fp1.view(np.int64)
            _, once = np.unique(cls, return_index=True)
            single = np.zeros(len(n), np.int64)
            single[once] = n[once]
            key, owner = block_keys(h, cut, single, cls, plan, percent)
            held.append((key, owner))
            size += len(key)
            if size > GROUP_KEYS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held):
        key, owner = (np.concatenate(x) for x in zip(*held, strict=True))
        key, owner = _distinct(key, owner)
        cut, n = _runs(key)
        wide = np.repeat(n > 2, n)
        lead = np.repeat(owner[cut[:-1]], n)
        other = wide & (owner != lead)
        turn = int(owner[0]) if len(owner) else 0
        # what the batch decides passes through the groups' exchange in parts of its own
        out = [(-1 - (turn + i) % spread, b"", b"", b"", *row) for i, row in enumerate(_rows_of(lead[other], owner[other], key[wide], owner[wide]))]
        sent = ~wide
        sent[cut[:-1]] = True
        key, owner, more = key[sent], owner[sent], wide[sent]
        group = (((key >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        key, owner, more, group = key[order], owner[order], more[order], group[order]
        cut, n = _runs(group)
        out += [(int(group[a]), key[a:b].tobytes(), owner[a:b].tobytes(), more[a:b].tobytes(), b"", b"", b"", b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "key", "owner", "more", *PACKED])

    def meet(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table.select(PACKED)
        key, cls, more = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("key", np.uint64), ("owner", np.int64), ("more", bool)))
        order = np.lexsort((cls, key))
        key, cls, more = key[order], cls[order], more[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]))
        key, cls, more = key[new], cls[new], np.logical_or.reduceat(more, new)
        cut, n = _runs(key)
        lead = np.repeat(cls[cut[:-1]], n)
        other = cls != lead
        pair = np.unique(np.stack([lead[other], cls[other]], 1), axis=0)
        # a class with more of its batch behind it is listed there
        wide = np.repeat((n > 1) & (n + np.add.reduceat(more.astype(np.int64), cut[:-1]) > 2), n) & ~more
        rows = list(_rows_of(pair[:, 0], pair[:, 1], key[wide], cls[wide]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in columns], PACKED)

    blobs = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "part long, key binary, owner binary, more binary, a binary, b binary, keys binary, owners binary")
    return blobs.groupBy("part").applyInArrow(meet, "a binary, b binary, keys binary, owners binary")


PACKED = ["a", "b", "keys", "owners"]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, with the end; and their lengths."""
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return cut, np.diff(cut)


def _distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[keep], owner[keep]


def _rows_of(a: np.ndarray, b: np.ndarray, key: np.ndarray, owner: np.ndarray) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    for at in range(0, len(a), ROW_ENTRIES):
        yield a[at : at + ROW_ENTRIES].tobytes(), b[at : at + ROW_ENTRIES].tobytes(), b"", b""
    for at in range(0, len(key), ROW_ENTRIES):
        yield b"", b"", key[at : at + ROW_ENTRIES].tobytes(), owner[at : at + ROW_ENTRIES].tobytes()


def _place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64), 60) % np.uint64(FILTER_CHUNKS << 15)).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each place of _place that a wanted id (column cls) has: a table of fixed size (2 MB), however many ids there
    are. It only spares work: what passes is joined with the ids."""

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_place(batch.column(0).to_numpy())))], ["place"])

    at = wanted.select("cls").mapInArrow(places, "place long")
    bits = at.groupBy(F.shiftright("place", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("place") % (1 << 15)).alias("bits")).collect()
    out = np.zeros((FILTER_CHUNKS, 1 << 12), np.uint8)
    for r in bits:
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _unpacked(blobs: DataFrame, x: str, y: str, names: str) -> DataFrame:
    first, second = names.split()

    def unpack(batches):
        for batch in batches:
            for p, q in zip(batch.column(0), batch.column(1), strict=True):
                if p.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (p, q)], [first, second])

    return blobs.select(x, y).mapInArrow(unpack, f"{first} long, {second} long")


def _across(open_: DataFrame, names: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs within a block, of different components, that the sketches allow; with best, for each class only the nearest.

    open_: key, cls, component, held (members of the block). Blocks are dealt to parts of about PART_ROWS rows, in which a
    pair is handed on once for all its blocks; a block of more than TILE members is dealt tile by tile to parts of its
    own."""
    parts = max(1, open_.count() // PART_ROWS)
    sized = open_.join(names, "cls").withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int"))
    tiled = sized.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    tiled = tiled.withColumn("p", F.least("tile", "other")).withColumn("q", F.greatest("tile", "other"))
    part = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.xxhash64("key", "p", "q"))
    tiled = tiled.select(part.alias("part"), "key", "p", "q", "tile", "cls", "n_shingles", "sketch", "component")

    def compare(table: pa.Table) -> pa.Table:
        key, p, q, tile, cls, comp, n = (table.column(c).to_numpy() for c in ("key", "p", "q", "tile", "cls", "component", "n_shingles"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(cls), -1)
        order = np.lexsort((cls, q, p, key))
        k = np.stack([key[order], p[order], q[order]])
        cut = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(0), [True]]))
        found = [np.empty((3, 0), np.int64)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows = order[a:b]
            left, right = rows[tile[rows] == p[rows[0]]], rows[tile[rows] == q[rows[0]]]
            for at, i in enumerate(left):
                j = left[at + 1 :] if p[i] == q[i] else right
                j = j[comp[j] != comp[i]]
                j = j[np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent]
                away = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                near = away * (100 + percent) <= (100 - percent) * (n[j] + n[i])
                j, away = j[near], away[near]
                if best and len(j):
                    # the nearest of i among later members; earlier ones have looked at i in their turn
                    near = np.lexsort((cls[j], away))[:1]
                    j, away = j[near], away[near]
                found.append(np.stack([np.full(len(j), cls[i]), cls[j], away]))
        x, y, away = np.concatenate(found, 1)
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x)) if not best else np.lexsort((y, away, x))
        x, y = x[order], y[order]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != x[:-1]) if best else (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return pa.table({"a": x[keep], "b": y[keep]})

    return tiled.groupBy("part").applyInArrow(compare, "a long, b long").distinct()


class _Shingles:
    """A text's distinct shingles by hash (bits wide), each with its first place; exact is whether equal hashes have equal
    words. A text of fewer than k words is one shingle."""

    def __init__(self, data: np.ndarray, k: int, bits: int):
        self.words = w = words(data, np.array([0, len(data)]), lower=True)
        self.k = min(k, len(w.start))
        h, at = runs(w.hash, w.doc, self.k) if self.k else (np.empty(0, np.uint64), np.empty(0, np.int64))
        h = h >> np.uint64(64 - bits)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        lead = np.repeat(at[first], np.diff(np.append(first, len(h))))
        again = at != lead
        self.exact = bool(same_words(w, at[again], w, lead[again], self.k).all()) if again.any() else True
        self.hash, self.at = h[first], at[first]

    def tuples(self) -> set[tuple[bytes, ...]]:
        own = self.words.data.tobytes().split()
        return {tuple(own[i : i + self.k]) for i in range(len(own) - self.k + 1)} if self.k else set()

    def linked(self, other: _Shingles, percent: int) -> bool:
        """Whether the sets' similarity is reached. Hashes can only show more in common than there is, so what they refuse
        is not compared; what they pass is, word by word, and set by set where a hash stands for several shingles."""

        def reached(n: int, m: int, both: int) -> bool:
            return both > 0 and 100 * both >= percent * (n + m - both)

        p, q = (self, other) if len(self.hash) <= len(other.hash) else (other, self)
        if p.exact and q.exact:
            if not len(p.hash):
                return False
            at = np.minimum(np.searchsorted(q.hash, p.hash), len(q.hash) - 1)
            met = np.flatnonzero(q.hash[at] == p.hash)
            if not reached(len(p.hash), len(q.hash), len(met)):
                return False
            if p.k == q.k and same_words(p.words, p.at[met], q.words, q.at[at[met]], p.k).all():
                return True
        x, y = self.tuples(), other.tuples()
        return reached(len(x), len(y), len(x & y))


def _verifier(k: int, percent: int, bits: int = 64):
    """Batches of pairs with packed texts -> those linked. bits is the width of hashes: fewer only cost time."""

    def verify(batches):
        last: dict[int, _Shingles] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                sets = []
                for name, col in ((x, "left"), (y, "right")):
                    got = last.get(name)
                    if got is None:
                        got = _Shingles(np.frombuffer(zstandard.decompress(batch.column(col)[i].as_py()), np.uint8), k, bits)
                        if len(last) > 256:
                            last.clear()
                        last[name] = got
                    sets.append(got)
                keep.append(sets[0].linked(sets[1], percent))
            kept = np.flatnonzero(keep)
            if len(kept):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept))], ["src", "dst"])

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose shingle sets reach the similarity. texts: cls, packed."""
    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("packed").alias("left")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("packed").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_verifier(k, percent), "src long, dst long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every document.

    Words are runs other than space and 09-0D, with A-Z lower-cased; a text of fewer than k words, but not none, has its
    whole sequence as one shingle. Null, empty and blank texts have no shingles and link with nothing. Rows that share a
    doc_id are one document: they link, and one row is returned, with the largest of their set sizes. Rows without a
    doc_id are left out. Other columns of docs are ignored. An empty table gives an empty result. percent is 1 to 100; the
    number of join keys is about a set's size times (100 - percent) / percent. Tables between the steps are written to the
    checkpoint folder and deleted.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    bands(percent)
    with Scratch(docs) as scratch:
        signed = scratch.hold(signatures(docs, k))
        # a class is a sequence of words; cls names it, two classes of one name only share their candidates
        classes = signed.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        classes = scratch.hold(classes)
        total = signed.agg(F.sum("n_shingles")).first()[0] or 0
        groups = max(1, int(total * 1.7 * (100 - percent) / percent) // GROUP_KEYS)
        found = scratch.hold(_candidates(docs, k, percent, groups))
        names = classes.select(F.col("fp1").alias("cls"), "rep", "n_shingles", "sketch")
        stars = _unpacked(found, "a", "b", "a b").distinct()
        wide = _unpacked(found, "keys", "owners", "key cls")

        def rename(df, col, to):
            x = names.select(F.col("cls").alias(col), F.col("rep").alias(to), F.col("n_shingles").alias(f"n_{to}"), F.col("sketch").alias(f"s_{to}"))
            return df.join(x, col)

        def bits(x, y):
            return sum(F.bit_count(F.conv(F.hex(F.substring(x, i, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring(y, i, 4)), 16, 10).cast("long"))) for i in range(1, SKETCH_BITS // 8, 4))

        near = rename(rename(stars, "a", "ra"), "b", "rb").where("100 * least(n_ra, n_rb) >= " + str(percent) + " * greatest(n_ra, n_rb)")
        near = near.where(bits(F.col("s_ra"), F.col("s_rb")) * (100 + percent) <= (100 - percent) * (F.col("n_ra") + F.col("n_rb")))
        near = scratch.hold(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct())
        members = scratch.hold(wide.join(names.select("cls", "rep"), "cls").select("key", F.col("rep").alias("cls")).distinct())
        scratch.drop(found)
        wanted = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).unionByName(members.select("cls")).distinct()

        wanted = scratch.hold(wanted)
        passing = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

        def pack(batches):
            squeeze = zstandard.ZstdCompressor(1).compress
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                at = _place(ids)
                some = np.flatnonzero((passing.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                data, off = text_buffer(batch.column(1).take(pa.array(some)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([squeeze(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["cls", "packed"])

        texts = scratch.hold(docs.mapInArrow(pack, "cls long, packed binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))
        links = scratch.hold(_verified(near, texts, k, percent))
        scratch.drop(near)
        sketches = names.select(F.col("rep").alias("cls"), "n_shingles", "sketch")
        for best in (True, True, False):
            comp = components(links)
            placed = members.select("key", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
            # a block within one component stays so; under a key of their own the blocks' counts are dealt anew, so that
            # Spark can split a block that many sets share
            several = placed.groupBy("key").agg(F.count("*").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
            several = several.select((F.col("key") + F.lit(0)).alias("block"), "held")
            open_ = scratch.hold(placed.join(several, F.col("key") == F.col("block")).drop("block"))
            more = scratch.hold(_across(open_, sketches, percent, best))
            scratch.drop(members)
            if more.isEmpty():
                break
            members = open_
            new = scratch.hold(links.unionByName(_verified(more, texts, k, percent)))
            scratch.drop(links, more)
            links = new
        # rows that share a doc_id but not a text are one document
        same = signed.where("n_shingles > 0").join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).select("doc_id", "rep")
        return checkpointed(_labelled(signed, same, links))


def _labelled(signed: DataFrame, same: DataFrame, links: DataFrame) -> DataFrame:
    several = same.groupBy("doc_id").agg(F.min("rep").alias("dst"), F.max("rep").alias("src")).where("dst < src")
    comp = components(links.unionByName(same.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))))
    found = same.join(comp.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    sizes = signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return sizes.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
