"""Gestalt ratios, as difflib's SequenceMatcher defines them, for thousands of pairs of texts at a time.

A pair's stretches in common are found once, by the pairs of letters that both texts hold. The longest stretch of a pair
splits it into what is before and after it, and each other stretch lies in one of the two parts at most. So all parts of all
pairs are split together, until nothing is left in common or a pair can no longer be the best of its group.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np

#: Products of lengths of the pairs that are worked on at once, their common letter pairs, entries of their table of letter
#: pairs, and cells that are compared at once. One pair beyond that is left to difflib.
CELLS, HITS, TABLE, AT_ONCE = 32 << 20, 1 << 20, 4 << 20, 2 << 20
#: Classes of letters of which bounds are made.
LETTERS = 128
#: Bits of a place in a text.
_BITS = 20
_LAST = (1 << _BITS) - 1


class Texts:
    """Distinct texts as code points, one after the other."""

    def __init__(self, texts: Sequence[str]):
        self.texts = list(texts)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.size)

    def letters(self) -> np.ndarray:
        """How often each text has letters of each class."""
        key = self.owner() * LETTERS + self.codes % LETTERS
        return np.bincount(key, minlength=len(self.texts) * LETTERS).astype(np.int32).reshape(-1, LETTERS)

    def popular(self) -> np.ndarray:
        """Of each letter, whether the matcher leaves it out as too frequent in its text."""
        owner = self.owner()
        _, key, count = np.unique(owner << 21 | self.codes, return_inverse=True, return_counts=True)
        return (self.size[owner] >= 200) & (count[key] > self.size[owner] // 100 + 1)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of count[i] rows of each i: i, and the row's number among them."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted rows."""
    return np.flatnonzero(np.diff(rows, prepend=-1))


def bounds(a: Texts, b: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the ratios of pairs of texts a[x] and b[y] are at most, by the letters they share; rare letters count as one."""
    mine, theirs = a.letters(), b.letters()
    out = np.ones(len(x))
    for at in range(0, len(x), AT_ONCE // LETTERS):
        s = slice(at, at + AT_ONCE // LETTERS)
        length = a.size[x[s]] + b.size[y[s]]
        np.divide(2.0 * np.minimum(mine[x[s]], theirs[y[s]]).sum(1, dtype=np.int64), length, out=out[s], where=length > 0)
    return out


def ratios(a: Texts, b: Texts, x: np.ndarray, y: np.ndarray, group: np.ndarray, best: np.ndarray) -> np.ndarray:
    """SequenceMatcher(None, a, b).ratio() of pairs of texts a[x] and b[y]. best has for each group a ratio that counts, and
    is raised to what its pairs reach; a pair that turns out to be less than that by over a millionth gets -1."""
    out = np.full(len(x), -1.0)
    cells = np.cumsum(a.size[x] * b.size[y] + 1)
    at = 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
        _settle(a, b, x[at:end], y[at:end], group[at:end], best, out[at:end])
        at = end
    return out


def _settle(a: Texts, b: Texts, x, y, group, best, out) -> None:
    """ratios of so many pairs that half of them, or difflib for a single one, will do where they hold too much."""
    length = a.size[x] + b.size[y]
    if a.size[x].max() < _LAST and b.size[y].max() < _LAST:
        runs = _runs(a, b, x, y)
        if runs is not None:
            matched, alive = _split(a, b, x, y, group, best, length, *runs)
            out[:] = np.where(alive, np.where(length > 0, 2.0 * matched / np.maximum(length, 1), 1.0), -1.0)
            np.maximum.at(best, group, out)
            return
    if len(x) > 1:
        half = len(x) // 2
        for s in (slice(half), slice(half, None)):
            _settle(a, b, x[s], y[s], group[s], best, out[s])
        return
    out[0] = difflib.SequenceMatcher(None, a.texts[x[0]], b.texts[y[0]]).ratio()
    best[group[0]] = max(best[group[0]], out[0])


def _runs(a: Texts, b: Texts, x, y):
    """(pair, place in a, place in b, length) of stretches in common: all of two letters and more, or of one, where b has
    popular letters, and which texts of b have some; None if they are too many."""
    used, y = np.unique(y, return_inverse=True)
    mine = Texts([b.texts[i] for i in used])
    popular = mine.popular()
    owner, place = mine.owner(), np.arange(len(mine.codes))
    single = np.zeros(len(used), bool)
    single[owner[popular]] = True
    # a letter, or it and the next one, as one number
    place = place[np.where(single[owner], ~popular, place + 1 < mine.at[owner + 1])]
    pair = np.append(mine.codes, 0)
    pair = pair[:-1] << 21 | pair[1:] + 1
    gram = np.where(single[owner[place]], mine.codes[place] << 21, pair[place])
    grams, gram = np.unique(gram, return_inverse=True)
    if len(used) * len(grams) > TABLE:
        return None
    key = owner[place] * len(grams) + gram
    place = place[np.argsort(key, kind="stable")]
    count = np.bincount(key, minlength=len(used) * len(grams))
    first = np.cumsum(count) - count
    # the same of a's letters; what b lacks is the number of grams
    codes = np.append(a.codes, 0)

    def known(g: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(grams, g), max(len(grams) - 1, 0))
        return np.where(grams[at] == g, at, -1) if len(grams) else np.full(len(g), -1)

    row, i = _spread(np.where(single[y], a.size[x], np.maximum(a.size[x] - 1, 0)))
    at = a.at[x[row]] + i
    lo, hi = (int(at.min()), int(at.max()) + 1) if len(at) else (0, 0)
    ones, twos = known(codes[lo:hi] << 21), known(codes[lo:hi] << 21 | codes[lo + 1 : hi + 1] + 1)
    g = np.where(single[y[row]], ones[at - lo], twos[at - lo])
    row, i, g = (v[g >= 0] for v in (row, i, g))
    key = y[row] * len(grams) + g
    many = count[key]
    if many.sum() > HITS:
        return None
    hit, nth = _spread(many)
    row, i = row[hit], i[hit]
    j = place[first[key][hit] + nth] - mine.at[y[row]]
    # along the diagonals
    key = np.sort(row << 2 * _BITS + 1 | (j - i + _LAST) << _BITS | i)
    begin = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    size = np.diff(np.append(begin, len(key)))
    row, i = key[begin] >> 2 * _BITS + 1, key[begin] & _LAST
    j = (key[begin] >> _BITS & (1 << _BITS + 1) - 1) - _LAST + i
    return row, i, j, size + ~single[y[row]], single[y]


def _split(a: Texts, b: Texts, x, y, group, best, length, run, i, j, size, single):
    """Letters matched of each pair, and whether the pair was followed to its end."""
    matched, alive = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    # parts of pairs: pair, bounds in a and in b, whether their runs of one letter are known
    pair, zero = np.arange(len(x)), np.zeros(len(x), np.int64)
    parts = np.array([pair, zero, a.size[x], zero, b.size[y], single])
    a0, b0 = a.at[x], b.at[y]
    part = run
    while True:
        pair, alo, ahi, blo, bhi, single = parts
        most = np.bincount(pair, np.minimum(ahi - alo, bhi - blo), len(x)) + matched
        np.maximum.at(best, group, 2.0 * matched / np.maximum(length, 1))
        alive &= (length == 0) | (2.0 * most >= (best[group] - 1e-6) * length)
        # parts without a run of two letters are asked for runs of one
        has = np.zeros(len(pair), bool)
        has[part] = True
        ask = np.flatnonzero(~has & (single == 0) & alive[pair] & (ahi > alo) & (bhi > blo))
        if len(ask):
            new = _ones(a.codes, b.codes, a0[pair[ask]], b0[pair[ask]], parts[:, ask])
            parts[5, ask] = 1
            part, i, j, size = (np.concatenate(v) for v in zip((part, i, j, size), (ask[new[0]], *new[1:], np.ones(len(new[0]), np.int64)), strict=True))
            has[part] = True
        # without a run the matcher takes what is equal at the beginning, popular letters too
        more = np.flatnonzero(~has & alive[pair])
        ai, bi = alo.copy(), blo.copy()
        while len(more := more[(ai[more] < ahi[more]) & (bi[more] < bhi[more])]) and len(more := more[a.codes[(a0[pair] + ai)[more]] == b.codes[(b0[pair] + bi)[more]]]):
            ai[more] += 1
            bi[more] += 1
        matched += np.bincount(pair, ai - alo, len(x)).astype(np.int64)
        keep = has & alive[pair]
        number = np.cumsum(keep) - 1
        go = keep[part]
        part, i, j, size = number[part[go]], i[go], j[go], size[go]
        parts = parts[:, keep]
        if not parts.shape[1]:
            return matched, alive
        order = np.argsort(part, kind="stable")
        part, i, j, size = part[order], i[order], j[order], size[order]
        # the longest run, the first in a, then in b
        top = np.maximum.reduceat(size << 2 * _BITS | (_LAST - i) << _BITS | _LAST - j, _starts(part))
        bi, bj, k = _LAST - (top >> _BITS & _LAST), _LAST - (top & _LAST), top >> 2 * _BITS
        pair, alo, ahi, blo, bhi, single = parts
        ca, cb = a0[pair], b0[pair]
        # popular letters beside it count too
        more = np.arange(len(pair))
        while len(more := more[(bi[more] > alo[more]) & (bj[more] > blo[more])]) and len(more := more[a.codes[ca[more] + bi[more] - 1] == b.codes[cb[more] + bj[more] - 1]]):
            bi[more] -= 1
            bj[more] -= 1
            k[more] += 1
        more = np.arange(len(pair))
        while len(more := more[(bi[more] + k[more] < ahi[more]) & (bj[more] + k[more] < bhi[more])]) and len(more := more[a.codes[(ca + bi + k)[more]] == b.codes[(cb + bj + k)[more]]]):
            k[more] += 1
        matched += np.bincount(pair, k, len(x)).astype(np.int64)
        # what is left of each run before and after it
        ri, rj, rk = bi[part], bj[part], k[part]
        before = (i < ri) & (j < rj)
        cut = np.maximum(0, np.maximum(ri + rk - i, rj + rk - j))
        left = np.where(before, np.minimum(size, np.minimum(ri - i, rj - j)), size - cut)
        i, j = np.where(before, i, i + cut), np.where(before, j, j + cut)
        go = left >= 2 - single[part]
        part, i, j, size = (2 * part + np.where(before, 0, 1))[go], i[go], j[go], left[go]
        parts = np.stack([np.array([pair, alo, bi, blo, bj, single]), np.array([pair, bi + k, ahi, bj + k, bhi, single])], axis=2).reshape(6, -1)


def _ones(a: np.ndarray, b: np.ndarray, a0, b0, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, place in a, place in b) of equal letters, so many cells at a time."""
    _, alo, ahi, blo, bhi, _ = parts
    cells = (ahi - alo) * (bhi - blo)
    out, at, total = [], 0, np.cumsum(cells)
    while at < len(cells):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        row, nth = _spread(cells[at:end])
        row += at
        wide = (bhi - blo)[row]
        i, j = alo[row] + nth // wide, blo[row] + nth % wide
        same = a[a0[row] + i] == b[b0[row] + j]
        out.append((row[same], i[same], j[same]))
        at = end
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))
