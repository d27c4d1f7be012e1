"""Words and shingles of Arrow text columns as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in slices of about so many bytes; longer texts alone.
SLICE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for i, base in enumerate((_BASE, _UNBASE)):
            full = np.full(n + 1, base, np.uint64)
            full[0] = 1
            _powers[i] = np.cumprod(full, dtype=np.uint64)
    return _powers[0], _powers[1]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of runs of rows; null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII space) and each row's first word's place.

    A word's hash is a polynomial of its bytes; as differences of one running sum it
    costs the same for long words as for short ones.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | last[1:])) + 1
    power, unpower = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[begins]) * unpower[begins])
    return hashes, np.searchsorted(begins, offsets).astype(np.int64)


def shingles(words: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and each row's first one's place.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(places)
    n_out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_places = np.concatenate(([0], np.cumsum(n_out)))
    if not len(words):
        return np.zeros(0, np.uint64), out_places
    row = np.repeat(np.arange(len(counts)), n_out)
    start = np.arange(out_places[-1]) - out_places[:-1][row] + places[:-1][row]
    size = np.minimum(counts, width)[row]
    out = size.astype(np.uint64)
    for k in range(width):
        inside = k < size
        step = mix(out * np.uint64(0xD1342543DE82EF95) + words[np.where(inside, start + k, start)])
        out = np.where(inside, step, out)
    return out, out_places


def shingle_sets(texts: pa.Array, width: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(words in the row, sorted distinct shingle hashes) row by row."""
    for _, data, offsets in slices(texts):
        words, places = word_hashes(data, offsets, lower)
        grams, at = shingles(words, places, width)
        for i in range(len(at) - 1):
            yield int(places[i + 1] - places[i]), np.unique(grams[at[i] : at[i + 1]])
