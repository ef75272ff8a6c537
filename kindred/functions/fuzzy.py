"""Fuzzy name similarity as vectorised UDFs, for candidates that blocking has already brought together.

Ratios are the published Indel similarity and what is composed of it; all are in 0..100 unless said otherwise.
"""

from __future__ import annotations

import difflib
import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import unaccented

from .text import phonetic_token  # noqa: F401  the Column form of what _sound does below


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    rows = ones = (1 << len(a)) - 1
    for ch in b:
        u = rows & at.get(ch, 0)
        rows = ((rows + u) | (rows - u)) & ones
    return len(a) - bin(rows).count("1")


#: Pairs whose longest common subsequences are worked out at once, and the longest text that is part of that.
TOGETHER, LONG = 4096, 512


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs of each pair of texts: the recurrence on bits, for thousands of pairs at a time, in as many 64-bit words as the
    longest text of the chunk needs."""
    out = np.zeros(len(a), np.int64)
    size = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for i in np.flatnonzero((size.max(1) > LONG) & (size.min(1) > 0)):
        out[i] = lcs(a[i], b[i])
    some = np.flatnonzero((size.min(1) > 0) & (size.max(1) <= LONG))
    # texts of one length take as many steps
    some = some[np.argsort(size[some].max(1), kind="stable")]
    for at in range(0, len(some), TOGETHER):
        rows = some[at : at + TOGETHER]
        out[rows] = _lcs_chunk([a[i] for i in rows], [b[i] for i in rows])
    return out


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a text a row, and the texts' lengths."""
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), size.max()), fill, np.int64)
    out[np.arange(size.max()) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, size


def _lcs_chunk(a: list[str], b: list[str]) -> np.ndarray:
    (x, n), (y, _) = _codes(a, -1), _codes(b, -2)
    words = -(-x.shape[1] // 64)
    # a bit for each letter of a that the letter of b equals
    match = np.zeros((words, len(a), y.shape[1]), np.uint64)
    for k in range(x.shape[1]):
        match[k // 64] |= (y == x[:, k, None]).astype(np.uint64) << np.uint64(k % 64)
    rows = np.full((words, len(a)), ~np.uint64(0))
    for j in range(y.shape[1]):
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            u = rows[w] & match[w, :, j]
            total = rows[w] + u
            over = total < u
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            rows[w] = total | (rows[w] & ~u)
    place = np.arange(words)[:, None] * 64
    inside = np.clip(n[None, :] - place, 0, 64)
    ones = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~rows & ones).sum(0, dtype=np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """plain_ratio of each pair."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(n > 0, 200.0 * lcs_many(a, b) / np.where(n > 0, n, 1), 100.0)


def sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """sort_ratio of each pair."""
    return ratios([_sorted(x) for x in a], [_sorted(x) for x in b])


def set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """set_ratio of each pair."""
    out = np.zeros(len(a))
    owner, left, right = [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = set(s.split()), set(t.split())
        if not x or not y:
            continue
        common, p, q = sorted(x & y), sorted(x - y), sorted(y - x)
        if common and (not p or not q):
            out[i] = 100.0
            continue
        both, one, two = " ".join(common), " ".join([*common, *p]), " ".join([*common, *q])
        pairs = [(one, two), (both, one), (both, two)] if common else [(one, two)]
        owner += [i] * len(pairs)
        left += [x for x, _ in pairs]
        right += [y for _, y in pairs]
    np.maximum.at(out, owner, ratios(left, right)) if owner else None
    return out


def window_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """window_ratio of each pair: its windows are pairs of their own."""
    out = np.zeros(len(a))
    owner, left, right = [], [], []

    def settle() -> None:
        np.maximum.at(out, owner, ratios(left, right))
        owner.clear(), left.clear(), right.clear()

    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        if not x:
            out[i] = 0.0 if y else 100.0
            continue
        n, chars = len(x), set(x)
        if x in y:
            out[i] = 100.0
            continue
        windows = {y[max(0, j) : j + n] for j in range(1 - n, len(y)) if (y[j + n - 1 if j + n <= len(y) else -1] if j >= 0 else y[0]) in chars}
        owner += [i] * len(windows)
        left += [x] * len(windows)
        right += windows
        if len(owner) > 8 * TOGETHER:
            settle()
    if owner:
        settle()
    return out


def weighted_ratios(a: list[str], b: list[str], least: float = 0.0) -> np.ndarray:
    """weighted_ratio of each pair; with least, pairs whose letters and lengths already show that they don't reach it may
    have less than their ratio, but then less than least."""
    size = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.float64).reshape(-1, 2)
    out = np.zeros(len(a))
    some = np.flatnonzero(size.min(1) > 0)
    if not len(some):
        return out
    wide = size[some].max(1) / size[some].min(1)
    near, far = some[wide < 1.5], some[wide >= 1.5]
    pick = lambda rows: ([a[i] for i in rows], [b[i] for i in rows])
    if len(near):
        out[near] = ratios(*pick(near))
        # the other two count 0.95 at most
        rest = near[out[near] < 95.0]
        if least > 95.0:
            rest = rest[:0]
        if len(rest):
            x, y = pick(rest)
            out[rest] = np.maximum(out[rest], 0.95 * np.maximum(sort_ratios(x, y), set_ratios(x, y)))
    if len(far):
        scale = np.where(wide[wide >= 1.5] <= 8, 0.9, 0.6)
        # what windows can give is bounded by their scale
        able = 100.0 * scale >= least
        out[far] = ratios(*pick(far))
        far, scale = far[able], scale[able]
        if len(far):
            x, y = pick(far)
            tokens = np.array([100.0 if set(s.split()) & set(t.split()) else -1.0 for s, t in zip(x, y, strict=True)])
            open_ = np.flatnonzero(tokens < 0)
            if len(open_):
                tokens[open_] = window_ratios([_sorted(x[i]) for i in open_], [_sorted(y[i]) for i in open_])
            out[far] = np.maximum.reduce([out[far], scale * window_ratios(x, y), 0.95 * scale * tokens])
    return out


def plain_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def sort_ratio(a: str, b: str) -> float:
    return plain_ratio(_sorted(a), _sorted(b))


def set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, p, q = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not p or not q):
        return 100.0
    both = " ".join(common)
    one, two = " ".join([*common, *p]), " ".join([*common, *q])
    best = plain_ratio(" ".join([*common, *p]), " ".join([*common, *q]))
    return max(best, plain_ratio(both, one), plain_ratio(both, two)) if common else best


def window_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows running over its ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    chars = set(a)
    for i in range(1 - n, len(b)):
        w = b[max(0, i) : i + n]
        # a window that begins or ends with a foreign letter is no better than a smaller one
        if i >= 0 and w[-1] not in chars or i < 0 and w[0] not in chars:
            continue
        best = max(best, plain_ratio(a, w))
        if best == 100.0:
            break
    return best


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios, scaled down for those that see less of the texts."""
    if not a or not b:
        return 0.0
    n = max(len(a), len(b)) / min(len(a), len(b))
    best = plain_ratio(a, b)
    if n < 1.5:
        return max(best, 0.95 * max(sort_ratio(a, b), set_ratio(a, b)))
    scale = 0.9 if n <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    partial_tokens = 100.0 if x & y else max(window_ratio(_sorted(a), _sorted(b)), 0.0)
    return max(best, scale * window_ratio(a, b), 0.95 * scale * partial_tokens)


def _fold(s: str | None) -> str:
    return unaccented((s or "").lower())


def _sound(word: str) -> str:
    import re

    t = re.sub("[^a-z]", "", _fold(word))
    for old, new in (("ch", "x"), ("qu", "k"), ("gue", "ge"), ("gui", "gi"), ("ll", "y"), ("h", ""), ("v", "b")):
        t = t.replace(old, new)
    t = re.sub("z|c(?=[ei])", "s", t).replace("c", "k")
    t = re.sub("g(?=[ei])", "j", t).translate(str.maketrans("wy", "bi"))
    return re.sub(r"(.)\1+", r"\1", t)


def name_match(query: str | None, other: str | None) -> float:
    """FZ5 in 0..1: 0.6 of the share of words that agree, one to one, and 0.4 of the sorted ratio; 0 if under a quarter of
    the query's words agree. Words agree if equal, alike by 85, or of one sound; words of under 3 letters don't count."""
    q, c = _fold(query), _fold(other)
    mine: dict[str, str] = {}
    for w in q.split():
        if len(w) >= 3:
            mine.setdefault(_sound(w), w)
    theirs = [w for w in c.split() if len(w) >= 3]
    if not mine or not theirs:
        return 0.0
    left, hits = list(theirs), 0
    for sound, w in mine.items():
        hit = next((i for i, u in enumerate(left) if w == u or plain_ratio(w, u) >= 85 or sound == _sound(u)), None)
        if hit is not None:
            del left[hit]
            hits += 1
    if hits < 0.25 * len(mine):
        return 0.0
    return 0.6 * hits / max(len(mine), len(theirs)) + 0.004 * sort_ratio(q, c)


@functools.lru_cache(1 << 14)
def one_person(a: str | None, b: str | None) -> bool:
    """FZ6: one name's words are part of the other's, or the names score 0.85; true where either has none."""
    x, y = ({w for w in _fold(s).split() if len(w) >= 3} for s in (a, b))
    return not x or not y or x <= y or y <= x or name_match(a, b) >= 0.85


@functools.lru_cache(1024)
def _option(option: str | None) -> tuple[str, difflib.SequenceMatcher]:
    """An option's folded form and a matcher that has learnt it."""
    o = _fold(option)
    return o, difflib.SequenceMatcher(None, "", o)


def closest(text: str | None, options: list[str] | None, threshold: float) -> str | None:
    """FZ7: the option most like the text (gestalt ratio; 1 if it is one of the text's words, 0.8 at least if part of it).
    Lengths, then letters, bound the ratio: an option that can't be the one is not compared in full."""
    t, best, found = _fold(text), 0.0, None
    for option in options if options is not None else ():
        o, matcher = _option(option)
        if not o or not t:
            continue
        if f" {o} " in f" {t} ":
            score = 1.0
        else:
            matcher.set_seq1(t)
            score = 0.8 if o in t else 0.0
            able = lambda most: most >= threshold and most > max(best, score)  # noqa: B023, E731
            if able(matcher.real_quick_ratio()) and able(matcher.quick_ratio()):
                score = max(score, matcher.ratio())
        if score > best:
            best, found = score, option
    return found if best >= threshold else None


#: Functions of one pair -> of many.
MANY = {plain_ratio: ratios, sort_ratio: sort_ratios, window_ratio: window_ratios, weighted_ratio: weighted_ratios}


def scored(f, a: pd.Series, b: pd.Series) -> pd.Series:
    """f of each pair of texts, worked out once for pairs that a batch repeats; null where either is."""
    pairs = pd.DataFrame({"a": a.to_numpy(object), "b": b.to_numpy(object)})
    code = pairs.groupby(["a", "b"], sort=False, dropna=True).ngroup().fillna(-1).to_numpy(np.int64)
    _, first = np.unique(code, return_index=True)
    first = first[code[first] >= 0]
    x, y = (pairs[c].iloc[first].tolist() for c in "ab")
    got = MANY[f](x, y) if f in MANY else np.array([f(s, t) for s, t in zip(x, y, strict=True)], np.float64)
    return pd.Series(np.where(code >= 0, got[code] if len(got) else np.nan, np.nan), dtype="float64")


def _scores(f):
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return scored(f, a, b)

    return apply


def ratio(a: Column, b: Column) -> Column:
    """FZ1."""
    return _scores(plain_ratio)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """FZ2."""
    return _scores(sort_ratio)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    """FZ3."""
    return _scores(window_ratio)(a, b)


def wratio(a: Column, b: Column, preprocess: str | None = "lower") -> Column:
    """FZ4."""
    return _scores(weighted_ratio)(*((F.lower(a), F.lower(b)) if preprocess == "lower" else (a, b)))


def name_score(q: Column, c: Column) -> Column:
    """FZ5."""
    return _scores(name_match)(F.coalesce(q, F.lit("")), F.coalesce(c, F.lit("")))


def same_person(a: Column, b: Column) -> Column:
    """FZ6."""
    return _scores(lambda x, y: float(one_person(x, y)))(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))) == 1.0


def gestalt_match(text: Column, options: Column, threshold: float = 0.6) -> Column:
    """FZ7."""

    @F.pandas_udf("string")
    def apply(t: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([closest(x, list(y) if y is not None else None, threshold) for x, y in zip(t, o, strict=True)], dtype="object")

    return apply(text, options)
