"""Vectorised text primitives shared by the operators of this subpackage.

A batch of texts is laid out as one array of code points, so that word
boundaries, hashes and n-grams cost a few numpy passes instead of a Python
loop over words. Memory is about 60 bytes a code point of the slice in hand;
`slices` bounds that slice, and a longer text is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_CHARS = 125_000
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on an array of uint64."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_table() -> np.ndarray:
    """A random 64-bit value for each code point."""
    if "code" not in _tables:
        _tables["code"] = mix(np.arange(0x110000, dtype=np.uint64))
    return _tables["code"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, SLICE_CHARS + 65536)
        for name, base in (("pow", _POWER), ("inv", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["pow"][:n], _tables["inv"][:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batch with about `limit` characters and at most `rows` rows each, and their texts (null: empty)."""
    for first in range(0, batch.num_rows, rows):
        part = batch.slice(first, rows)
        texts = [t or "" for t in part.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield part.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        yield part.slice(start), texts[start:]
    pa.default_memory_pool().release_unused()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one line feed, and each text's start; one more start at the end."""
    joined = "\n".join(texts) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return c, at


def lowered(c: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((c >= 65) & (c <= 90), c + np.uint32(32), c)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


class RunHasher:
    """64-bit hashes of c[start:end] for any runs of the code points c, for features.

    A polynomial modulo 2**64, for which texts can be made that collide; keys that decide equality take `hash_runs`.
    """

    def __init__(self, c: np.ndarray) -> None:
        p, self.inverse = powers(len(c) + 1)
        self.total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(code_table()[c] * p[: len(c)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def multipliers(n: int) -> np.ndarray:
    """n independent random odd multipliers, one for each place in a run."""
    if "odd" not in _tables or len(_tables["odd"]) < n:
        _tables["odd"] = mix(np.arange(max(n, 4096), dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return _tables["odd"]


def hash_runs(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the runs c[start:end]: each code point's random value times a random multiplier of its place.

    The multipliers are independent, so no text is known whose key another one shares.
    """
    length = ends - starts
    odd = multipliers(int(length.max(initial=0)))
    index = ragged(starts, length)
    value = code_table()[c[index]]
    value *= odd[index - np.repeat(starts, length)]
    total = np.zeros(len(index) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    at = np.append(0, np.cumsum(length))
    return mix(total[at[1:]] - total[at[:-1]] + length.astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case.

    Returns code points, word starts, word ends, word hashes and the first
    word of each text (one more at the end).
    """
    c, at = codes(texts)
    c = lowered(c)
    starts, ends = runs(~((c == 32) | ((c >= 9) & (c <= 13))))
    return c, starts, ends, hash_runs(c, starts, ends), np.searchsorted(starts, at)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each run, all in a row."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - firsts, lengths)
