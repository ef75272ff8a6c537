"""Removal of word sequences that repeat across documents, by prefix-partitioned suffix trees.

A window is a number of consecutive words of one document; it is removed when it also starts in a document of a smaller
doc_id. Windows are split into groups that fit a task's memory by prefixes of variable length: a census counts prefixes of
1, 2 and 3 words over the whole corpus, and each window goes by the shortest of its prefixes that few enough windows share,
or else by all its words.

The prefix is taken at the window's anchor, the gram of GRAM words in it that has the least hash: equal windows have equal
anchors, and neighbouring windows of a text mostly share theirs, so a group gets the words of a stretch of windows once
instead of each window's. In a group all windows' suffixes, cut at the window's length, are sorted by their words; the
common-prefix lengths of neighbours give the tree's inner nodes, and nodes as deep as a window with leaves of several
documents are the repeats. Neighbouring repeats of a document make up its maximal repeats. Words themselves are compared;
hashes only deal out work.

Copies of a window within a task's batch are decided there, word by word, and only the smallest doc_id's are sent on, so a
window that a third of all documents hold reaches its group once a batch. Only stretches, never all texts, meet in a group.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import checkpointed
from ._words import _MULT, Words, mix, short_batches, slices, text_names, words

#: Windows that a group and a batch hold.
GROUP = 600_000
BATCH = 1_000_000
#: Words of an anchor, and of the prefixes by which windows are dealt out.
GRAM = 3
LEVELS = (1, 2, 3)
SLOT_BITS = 14
#: Text that one task puts together in the end.
TEXT_BYTES = 8 << 20
#: Shared doc_ids that are sent to every task.
FEW_IDS = 100_000


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each word among the distinct words in order of bytes, and how many there are. Words are what is no space
    in data."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    own = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[data != 32])]).dictionary_encode()
    rank = np.empty(len(own.dictionary), np.int32)
    rank[pc.sort_indices(own.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
    return rank[own.indices.to_numpy()], len(rank)


def leaves(codes: np.ndarray, n: int, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of the suffixes that begin at those words, cut at the window's length: the suffixes in the order of
    their words, and each one's common-prefix length with the one before it (0 for the first). codes are below n."""
    bits = max(1, (n - 1).bit_length())
    each = min(window, 63 // bits)

    def key(of: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(of), np.int64)
        for j in range(depth, min(window, depth + each)):
            out = (out << bits) | codes[of + j]
        return out

    first = key(at, 0)
    order = np.argsort(first)
    first = first[order]
    tied = np.zeros(len(at) + 1, bool)  # with the leaf before, as deep as has been read
    tied[1:-1] = first[1:] == first[:-1]
    for depth in range(each, window, each):
        some = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(some):
            break
        run, own = np.cumsum(~tied[:-1])[some], key(at[order[some]], depth)
        turn = np.lexsort((own, run))
        order[some] = order[some[turn]]
        run, own = run[turn], own[turn]
        tied[some[1:]] &= (run[1:] == run[:-1]) & (own[1:] == own[:-1])
    at = at[order]
    common, same = np.zeros(len(at), np.int64), np.arange(1, len(at))
    for j in range(window):
        same = same[codes[at[same] + j] == codes[at[same - 1] + j]]
        common[same] += 1
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First leaf and end of each inner node of that depth, by the common-prefix lengths of the leaves: neighbours that
    have as much in common."""
    first = np.flatnonzero(common < depth)
    end = np.append(first[1:], len(common))
    inner = end - first > 1
    return first[inner], end[inner]


def repeats(codes: np.ndarray, n: int, at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that begin at those words also begin in a smaller one of ids: the leaves of a node as deep as
    the window, but for those of the smallest id."""
    out = np.zeros(len(at), bool)
    order, common = leaves(codes, n, at, window)
    first, end = deep_nodes(common, window)
    if len(first):
        leaf = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange((end - first).sum())
        own = ids[order[leaf]]
        low = np.minimum.reduceat(own, np.cumsum(end - first) - (end - first))
        out[order[leaf]] = own > np.repeat(low, end - first)
    return out


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Index of the first word of each window, that of its anchor, hashes of the anchor's prefixes at LEVELS, and the
    window's own hash."""
    gram = min(GRAM, window)
    n, m = len(w.hash) - window + 1, len(w.hash) - gram + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), [np.empty(0, np.uint64) for _ in LEVELS], np.empty(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    total, prefixes = np.zeros(m, np.uint64), {}
    for j in range(gram):
        total += w.hash[j : j + m] * _MULT[j]
        prefixes[j + 1] = mix(total, 21 + j)
    h = mix(total, 20)
    least = h[at].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, h[at + j], out=least)
    anchor = at.copy()
    for j in range(window - gram, -1, -1):  # the first of equal ones stays
        anchor = np.where(h[at + j] == least, at + j, anchor)
    path = total[:n].copy()
    for j in range(gram, window):
        path += w.hash[j : j + n] * _MULT[j]
    return at, anchor, [prefixes[min(level, gram)][anchor] for level in LEVELS], mix(path[at], 26)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def census(docs: DataFrame, window: int) -> np.ndarray:
    """How many windows each slot of prefix hashes has at each level, over all documents: a table of fixed size."""
    chunk = 256

    def count(batches):
        table = np.zeros((len(LEVELS), 1 << SLOT_BITS), np.int64)
        for _, data, off in slices(batches):
            _, _, prefixes, _ = _windows(words(data, off), window)
            for level, h in enumerate(prefixes):
                table[level] += np.bincount(_slot(h), minlength=1 << SLOT_BITS)
        parts = table.reshape(-1, chunk)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    out = np.zeros(len(LEVELS) << SLOT_BITS, np.int64).reshape(-1, chunk)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.reshape(len(LEVELS), -1)


def prefix_plan(counts: np.ndarray, room: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """For each level and slot its first group, or -1 where the prefix must be longer; and the groups' number there
    (over 1 only at the last level, where full windows split what is left). A table of fixed size."""
    first, parts = np.full(counts.shape, -1, np.int64), np.ones(counts.shape, np.int64)
    group, held = 0, 0
    for level in range(len(counts)):
        last = level == len(counts) - 1
        for slot in np.flatnonzero(counts[level]):
            c = int(counts[level, slot])
            if c > room and not last:
                continue
            if held and held + c > room:
                group, held = group + 1, 0
            first[level, slot] = group
            held += c
            if c > room:
                parts[level, slot] = -(-c // room)
                group, held = group + int(parts[level, slot]), 0
    return first, parts


def _groups(prefixes: list[np.ndarray], path: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    group = np.full(len(path), -1, np.int64)
    for level, h in enumerate(prefixes):
        open_ = np.flatnonzero(group < 0)
        slot = _slot(h[open_])
        split = ((mix(path[open_], 22) >> np.uint64(32)) * parts[level, slot].astype(np.uint64)) >> np.uint64(32)
        group[open_] = np.where(first[level, slot] >= 0, first[level, slot] + split.astype(np.int64), -1)
    return group


def _encode(ids: np.ndarray, prints: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes]:
    """Rows (document, text's print, position), sorted by document, as a document table and positions by difference."""
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])]) if len(ids) else np.empty(0, bool)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(ids)))
    step = np.diff(pos, prepend=0)
    step[at] = pos[at]
    table = np.diff(ids[at], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    body = step.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    squeeze = zstandard.ZstdCompressor(1).compress
    head = np.array([len(at), len(ids)], np.int64).tobytes()
    return squeeze(head + table + prints[at].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype(np.uint32).tobytes()), squeeze(body)


def _decode(table: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, steps = zstandard.decompress(table), zstandard.decompress(body)
    d, m = np.frombuffer(raw, np.int64, 2)
    ids = np.cumsum(np.frombuffer(raw, np.uint8, 8 * d, 16).reshape(8, d).T.copy().view("<i8").ravel())
    prints = np.frombuffer(raw, np.uint8, 8 * d, 16 + 8 * d).reshape(8, d).T.copy().view("<u8").ravel()
    n = np.frombuffer(raw, np.uint32, d, 16 + 16 * d).astype(np.int64)
    step = np.frombuffer(steps, np.uint8).reshape(4, m).T.copy().view("<u4").ravel().astype(np.int64)
    total = np.cumsum(step)
    start = np.concatenate([[0], np.cumsum(n)[:-1]]) if d else np.empty(0, np.int64)
    total -= np.repeat(total[start] - step[start], n) if d else 0
    return np.repeat(ids, n), np.repeat(prints, n), total


def _prints(w, off: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of a text's words where other rows share its doc_id, to tell them apart; else 0."""
    if not shared.any():
        return np.zeros(len(shared), np.uint64)
    return np.where(shared, text_names(w, off)[:, 0], np.uint64(0))


def _emit(window: int, first: np.ndarray, parts: np.ndarray, buckets: int):
    """Batches of texts -> rows of groups (kind 0) and, decided within the batch, of repeats by document bucket (kind 1)."""

    def emit(batches):
        held: list[tuple] = []
        size = 0
        for piece, data, off in slices(batches):
            w = words(data, off)
            ids = np.asarray(piece.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)
            at, anchor, prefixes, path = _windows(w, window)
            shared = np.asarray(piece.column(2).to_numpy(zero_copy_only=False), bool)
            held.append((w, ids, at, anchor, _groups(prefixes, path, first, parts), path, _prints(w, off, shared)))
            size += len(at)
            if size > BATCH:
                yield from blobs(held)
                held, size = [], 0
        if size:
            yield from blobs(held)

    def blobs(held):
        """Of the slices' windows: what the batch decides, and the stretches that are left."""
        base = np.concatenate([[0], np.cumsum([len(w.start) for w, *_ in held])])
        room = np.concatenate([[0], np.cumsum([len(w.data) for w, *_ in held])])
        data = np.concatenate([w.data for w, *_ in held])
        start = np.concatenate([w.start + r for (w, *_), r in zip(held, room, strict=False)])
        end = np.concatenate([w.end + r for (w, *_), r in zip(held, room, strict=False)])
        at, anchor = (np.concatenate([x[i] + b for x, b in zip(held, base, strict=False)]) for i in (2, 3))
        ids, prints, pos = (np.concatenate(x) for x in zip(*((ids[w.doc[at]], prints[w.doc[at]], at - w.bounds()[w.doc[at]]) for w, ids, at, *_, prints in held), strict=True))
        group, path = (np.concatenate([x[i] for x in held]) for i in (4, 5))
        held.clear()
        codes, _ = word_codes(data, start, end)
        # windows of equal hashes are compared, word by word, with the one of the smallest doc_id
        order = np.lexsort((ids, path))
        run = np.flatnonzero(np.concatenate([[True], path[order[1:]] != path[order[:-1]]]))
        lead = np.empty(len(at), np.int64)
        lead[order] = np.repeat(order[run], np.diff(np.append(run, len(order))))
        some = np.flatnonzero(ids > ids[lead])
        same = np.ones(len(some), bool)
        for j in range(window):
            same &= codes[at[some] + j] == codes[at[lead[some]] + j]
        done = np.zeros(len(at), bool)
        done[some[same]] = True
        yield from _by_bucket(ids[done], prints[done], pos[done], buckets)
        at, anchor, ids, prints, pos, group = (x[~done] for x in (at, anchor, ids, prints, pos, group))
        # a stretch: windows that follow one another, of one anchor and group
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1]) | (pos[1:] == 0)]) if len(at) else np.empty(0, bool)
        first_ = np.flatnonzero(new)
        count = np.diff(np.append(first_, len(at)))
        order = np.lexsort((pos[first_], prints[first_], ids[first_], group[first_]))
        first_, count = first_[order], count[order]
        cut = np.flatnonzero(np.concatenate([[True], group[first_[1:]] != group[first_[:-1]], [True]])) if len(first_) else np.zeros(1, int)
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            f, n = first_[a:b], count[a:b]
            text = _joined(data, start, end, at[f], n + window - 1)
            rows.append((int(group[f[0]]), zstandard.ZstdCompressor(1).compress(n.astype("<u2").tobytes() + text), *_encode(ids[f], prints[f], pos[f].astype(np.int64))))
        yield _rows(0, rows)

    return emit


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """n words from each place on, every word followed by a space."""
    word = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    size = end[word] - start[word] + 1
    off = np.cumsum(size) - size
    out = data[np.minimum(np.repeat((start[word] - off).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32), len(data) - 1)]
    out[off + size - 1] = 32
    return out.tobytes()


def _stretches(blobs: list[bytes], rows: list[int], window: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Codes of all stretches' words and their number; of each window its first word, its stretch and its place there."""
    raw = [zstandard.decompress(x) for x in blobs]
    count = np.concatenate([np.frombuffer(x, "<u2", r) for x, r in zip(raw, rows, strict=True)]).astype(np.int64)
    data = np.concatenate([np.frombuffer(x, np.uint8, offset=2 * r) for x, r in zip(raw, rows, strict=True)])
    del raw
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    codes, n = word_codes(data, start, end)
    first = np.cumsum(count + window - 1) - (count + window - 1)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(owner))
    return codes, n, at, owner, at - first[owner]


def _meet(window: int, buckets: int):
    def meet(table: pa.Table) -> pa.Table:
        """One group's subtree, and the repeats below its deep nodes."""
        if table.column("kind")[0].as_py() == 1:
            return table
        decoded = [_decode(h.as_py(), b.as_py()) for h, b in zip(table.column("head"), table.column("body"), strict=True)]
        codes, n, at, owner, within = _stretches([x.as_py() for x in table.column("path")], [len(d[0]) for d in decoded], window)
        ids, prints, pos = (np.concatenate(x) for x in zip(*decoded, strict=True))
        found = np.flatnonzero(repeats(codes, n, at, ids[owner], window))
        of = owner[found]
        out = list(_by_bucket(ids[of], prints[of], pos[of] + within[found], buckets))
        return pa.Table.from_batches(out or [_rows(1, [])])

    return meet


def _rows(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    g, path, table, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(g), pa.int32()), pa.array(g, pa.int64()), pa.array(path, pa.binary()), pa.array(table, pa.binary()), pa.array(body, pa.binary())], ["kind", "part", "path", "head", "body"]
    )


def _by_bucket(ids: np.ndarray, prints: np.ndarray, pos: np.ndarray, buckets: int):
    if not len(ids):
        return
    bucket = _bucket(ids, prints, buckets)
    order = np.lexsort((pos, prints, ids, bucket))
    ids, prints, pos, bucket = ids[order], prints[order], pos[order].astype(np.int64), bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    yield _rows(1, [(int(bucket[a]), b"", *_encode(ids[a:b], prints[a:b], pos[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)])


def _bucket(ids: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(ids.view(np.uint64) + prints, 25) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


SCHEMA = "kind int, part long, path binary, head binary, body binary"


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words, joined by one space) of every row.

    Words are runs other than space and 09-0D, compared unchanged. Each word that is covered by a window also starting in
    a document of a smaller doc_id is removed; windows are judged on the input. Null, empty and short texts have no
    windows; a null text has no words and its result is the empty text. Rows that share a doc_id are one document to the
    rule (their windows don't remove one another) and are returned one by one. Rows without a doc_id are left out. Other
    columns are ignored. An empty table gives an empty result. A very long text is one piece of work in its own task.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    counts = census(docs, window)
    several = docs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared"))
    n_several = several.count()
    docs = docs.withColumn("shared", F.lit(False)) if not n_several else docs.join(F.broadcast(several) if n_several <= FEW_IDS else several, "doc_id", "left").na.fill(False, ["shared"])
    first, parts = prefix_plan(counts)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // TEXT_BYTES)

    suffixes = docs.mapInArrow(_emit(window, first, parts, buckets), SCHEMA)
    # what a batch has decided passes through in groups of its own
    found = suffixes.groupBy("kind", "part").applyInArrow(_meet(window, buckets), SCHEMA)

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        for piece, data, off in slices(batches):
            ids, shared = (np.asarray(piece.column(i).to_numpy(zero_copy_only=False)) for i in (0, 2))
            prints = _prints(words(data, off), off, shared) if shared.any() else np.zeros(len(ids), np.uint64)
            bucket = _bucket(ids, prints, buckets)
            raw, rows = data.tobytes(), []
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                body = b"".join(raw[off[i] : off[i + 1]] for i in at)
                rows.append((int(b), ids[at].tobytes(), np.diff(off)[at].astype(np.int64).tobytes() + prints[at].tobytes(), squeeze(body)))
            yield _rows(2, rows)

    def restore(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        marks: dict[tuple, list] = {}
        for i in np.flatnonzero(kind == 1):
            ids, prints, pos = _decode(table.column("head")[i].as_py(), table.column("body")[i].as_py())
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1]), [True]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                marks.setdefault((int(ids[a]), int(prints[a])), []).append(pos[a:b])
        out: list[tuple] = []
        for i in np.flatnonzero(kind == 2):
            ids, head = np.frombuffer(table.column("path")[i].as_py(), np.int64), table.column("head")[i].as_py()
            n, prints = np.frombuffer(head, np.int64, len(ids)), np.frombuffer(head, np.uint64, len(ids), 8 * len(ids))
            body, off = zstandard.decompress(table.column("body")[i].as_py()), np.concatenate([[0], np.cumsum(n)])
            for j, x in enumerate(ids):
                own = body[off[j] : off[j + 1]].split()
                at = marks.get((int(x), int(prints[j])))
                removed = 0
                total = len(own)
                if at:
                    cover = np.zeros(total + 1, np.int32)
                    starts = np.unique(np.concatenate(at))
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    removed = int(total - keep.sum())
                    own = list(compress(own, keep))
                out.append((int(x), total, removed, b" ".join(own)))
        ids, total, removed, text = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(text, pa.binary()).cast(pa.string())})

    texts = docs.mapInArrow(pack, SCHEMA)
    return checkpointed(found).unionByName(texts).groupBy("part").applyInArrow(restore, "doc_id long, n_words long, n_removed long, text string")
