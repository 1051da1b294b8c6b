"""Pre-tokens of byte-level BPE vocabularies, found with array operations.

The split pattern of the public rank files (`public_tokenizers.PATTERN`) only
looks at letters, numbers, white space and the rest, at single spaces before a
run, and at English contractions. So the boundaries follow from the class of
each code point and its neighbours, and no regular expression runs over the
text. `PieceCache` encodes each different piece once with a tokenizer library
and gathers the ids of all others by hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from tidewright.llm.textkernel import codes, hash_runs, ragged

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of each code point."""
    if not _classes:
        import regex

        everything = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0 for c in range(0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, everything):
                table[m.start() : m.end()] = kind
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def boundaries(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the texts c[at[i]:at[i+1]], ascending, with len(c) at the end.

    A text starts a piece; nothing is attached across texts.
    """
    n = len(c)
    if not n:
        return np.zeros(1, np.int64)
    kind = class_table()[c]
    first = np.zeros(n + 1, bool)
    first[at[at <= n]] = True
    first[n] = True
    new_run = np.empty(n + 1, bool)
    new_run[0] = new_run[n] = True
    new_run[1:n] = (kind[1:] != kind[:-1]) | first[1:n]
    start = new_run[:n].copy()
    space = kind == SPACE
    # the last character of a run of white space that more text follows
    last = space & new_run[1:] & ~first[1:]
    # it stands apart from the spaces before it ...
    start |= last
    # ... and a plain space joins what follows
    joins = np.flatnonzero(last & (c == 32)) + 1
    start[joins] = False
    # contractions: an apostrophe alone that starts a piece, then s t m d re ve ll
    quote = np.flatnonzero((c == 39) & start & (np.arange(n) + 1 < n))
    if len(quote):
        nxt, ok = c[quote + 1], ~first[quote + 1]
        two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], c[np.minimum(quote + 2, n - 1)], 0)
        one = ok & np.isin(nxt, [ord(x) for x in "stmd"])
        pair = ok & (((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e"))) | ((nxt == ord("l")) & (two == ord("l"))))
        for which, width in ((one, 2), (pair, 3)):
            q = quote[which]
            start[q + 1] = False
            if width == 3:
                start[q + 2] = False
            after = q + width
            start[after[after < n]] = True
        end = np.concatenate([quote[one] + 2, quote[pair] + 3])
        end = end[end < n]
        start[end] = True
    start[0] = True
    return np.append(np.flatnonzero(start), n)


class PieceCache:
    """Ids of pieces by their hash; `encode` gives the ids of a list of pieces.

    Keys are one sorted array, so that a slice's pieces are looked up at once. At most `limit` pieces are kept, then
    the cache starts anew. Pieces above `longest` code points are always encoded afresh.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 800_000, longest: int = 512) -> None:
        self.encode, self.limit, self.longest = encode, limit, longest
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        ids = np.array([x for y in found for x in y], np.uint32)
        sizes = np.array([len(y) for y in found], np.int32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        n = len(self.keys)
        while n + len(keys) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, place, keys[order])
        self.slot = np.insert(self.slot, place, n + order.astype(np.int32))
        self.used += len(ids)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not kept."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def lookup(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each piece. `text` has the code points c."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys = hash_runs(c, starts, ends)
        which, different = pd.factorize(keys)
        if len(self.keys) + len(different) > self.limit:
            self.clear()
        place = self._find(different)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            first = np.zeros(len(different), np.int64)
            first[which[::-1]] = np.arange(len(keys) - 1, -1, -1)
            at = first[missing]
            self._add(different[missing], self.encode([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            place = self._find(different)
        slot = place[which]
        sizes = self.size[slot].astype(np.int64)
        ids = self.flat[ragged(self.at[slot], sizes)]
        far = np.flatnonzero(ends - starts > self.longest)
        if len(far):  # long pieces do not rest on the hash
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, got in zip(far.tolist(), self.encode([text[starts[i] : ends[i]] for i in far]), strict=True):
                parts[i], sizes[i] = np.array(got, np.uint32), len(got)
            ids = np.concatenate(parts)
        return ids, sizes


def split_batch(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, code points, piece starts, piece ends, first piece of each text; separators are no pieces."""
    c, at = codes(texts)
    marks = np.unique(np.concatenate([at, at[1:] - 1]))
    b = boundaries(c, marks)
    starts, ends = b[:-1], b[1:]
    keep = np.ones(len(starts), bool)
    keep[np.searchsorted(starts, at[1:] - 1)] = False
    starts, ends = starts[keep], ends[keep]
    return "\n".join(texts) + "\n", c, starts, ends, np.searchsorted(starts, at)
