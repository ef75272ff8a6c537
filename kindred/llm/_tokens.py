"""Token ids by public vocabularies. Texts are cut where no token of either kind can reach across, and each distinct piece is encoded once."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Pieces that a task remembers, and the ids of all of them.
KNOWN, KNOWN_IDS = 1 << 20, 1 << 24
#: Pieces that are encoded at a time.
AT_ONCE = 8192


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


_KIND = np.zeros(256, np.uint8)
_LETTER, _MARK, _DIGIT, _BREAK, _SPACE, _OTHER = 1, 2, 4, 8, 16, 32
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[10], _KIND[32], _KIND[128:] = _BREAK, _SPACE, _OTHER
_VISIBLE = _LETTER | _MARK | _DIGIT


def piece_starts(data: np.ndarray, off: np.ndarray, words: bool = False) -> np.ndarray:
    """Where the pieces of UTF-8 texts begin: at each text, and at a space after a visible ASCII character, or after a byte
    of another character if a visible ASCII character follows; with words also at a mark other than | after a letter, at a line
    break after a visible character and at a visible character after such a break (all of ASCII).

    Byte-level vocabularies split at all of these places whatever is around them (| can be inside a special token). Pieces
    of the other kind have their space in front and none inside. So the ids of a text are those of its pieces, one after
    the other."""
    if not len(data):
        return np.empty(0, np.int64)
    kind = _KIND[data]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0] = after[-1] = 0
    before[1:], after[:-1] = kind[:-1], kind[1:]
    seen = (before & _VISIBLE) > 0
    cut = (kind == _SPACE) & (seen | ((before == _OTHER) & ((after & _VISIBLE) > 0)))
    if words:
        single = np.zeros(len(data), bool)
        single[1:] = ((kind == _BREAK) & seen)[:-1]
        cut |= ((kind == _MARK) & (before == _LETTER) & (data != 124)) | ((kind == _BREAK) & seen) | (single & ((kind & _VISIBLE) > 0))
    cut[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts; encode gives the ids of each of a list of pieces. It remembers a share-th of what a task may."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], words: bool, share: int = 1):
        self.encode, self.words, self.share = encode, words, share
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.filled = np.empty(1 << 16, np.int32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _grown(self, x: np.ndarray, size: int) -> np.ndarray:
        if size <= len(x):
            return x
        out = np.empty(max(size, 2 * len(x)), x.dtype)
        out[: len(x)] = x
        return out

    def _places(self, names: list[str]) -> np.ndarray:
        if len(self.known) + len(names) > KNOWN // self.share or self.filled > KNOWN_IDS // self.share:
            self._forget()
        known = self.known
        new = [x for x in names if x not in known]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            ids = self.encode(some)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            place = len(known)
            self.flat = self._grown(self.flat, self.filled + int(n.sum()))
            self.first, self.count = (self._grown(x, place + len(some)) for x in (self.first, self.count))
            self.flat[self.filled : self.filled + int(n.sum())] = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
            self.first[place : place + len(some)] = self.filled + np.cumsum(n) - n
            self.count[place : place + len(some)] = n
            self.filled += int(n.sum())
            known.update(zip(some, range(place, place + len(some)), strict=True))
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, and where each text's ids begin, with the end."""
        at = piece_starts(data, off, self.words)
        ends = np.append(at, len(data)).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        coded = column.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        count = self.count[place]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[place] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(at, off)]


# what a worker process has encoded serves its later tasks too
@lru_cache(2)
def byte_level(source: bytes, special_as_text: bool, share: int = 1) -> Encoder:
    """Encoder of a byte-level vocabulary file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(source)
    tokenizer.encode_special_tokens = special_as_text
    return Encoder(lambda pieces: [x.ids for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], True, share)


@lru_cache(1)
def piece_level(source: bytes, share: int = 1) -> Encoder:
    """Encoder of a sentencepiece model, which sets a space before a text, so that pieces go without theirs; a space alone
    is a piece of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=source)
    space = [model.piece_to_id("▁")]
    return Encoder(lambda pieces: [space if x == " " else y for x, y in zip(pieces, model.encode([x[1:] for x in pieces], num_threads=1), strict=True)], False, share)
