"""Word and shingle hashes of whole texts, computed on the UTF-8 bytes of Arrow columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Work goes by pieces of about
PIECE_BYTES, cut at white space, so that one very long text takes no more memory than its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import sized_slices, text_buffers

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _piece_words(data: np.ndarray, breaks: np.ndarray, fold: bool, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of data; a word also ends before each place in breaks."""
    global _powers
    solid = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = ~solid[:-1]
    before[:1] = True
    before[breaks] = True
    if marks is not None:
        before[1:] |= marks[data[1:]] & LETTER[data[:-1]]
    starts = np.flatnonzero(solid & before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    after = np.empty(len(data), bool)
    after[:-1] = before[1:] | ~solid[1:]
    after[-1:] = True
    ends = np.flatnonzero(solid & after) + 1
    lengths = ends - starts
    if lengths.max() > len(_powers):
        _powers = powers(1 << int(lengths.max()).bit_length())
    codes = (LOWER[data[solid]] if fold else data[solid]).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(codes)) - np.repeat(first, lengths)
    hashes = np.add.reduceat((codes + np.uint64(1)) * _powers[place], first)
    return mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, spans: bool = False, fold: bool = True, marks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hashes, first) of the words of consecutive texts: text i has hashes[first[i] : first[i + 1]].

    With spans, also the words' starts and ends as places in data. Without fold, A-Z and a-z differ.
    A word ends also where a byte of the table `marks` follows A-Z or a-z.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    found: list[tuple[np.ndarray, ...]] = []
    while low < high:
        end = min(high, low + PIECE_BYTES)
        if end < high:
            behind = data[low:end]
            space = np.flatnonzero(SPACE[behind[-4096:]])
            if len(space):
                end = end - min(4096, len(behind)) + int(space[-1])
                end = max(end, low + 1)
            else:  # a very long word: go on to its end
                nxt = end
                while nxt < high and not SPACE[data[nxt]]:
                    step = np.flatnonzero(SPACE[data[nxt : nxt + PIECE_BYTES]])
                    nxt = nxt + int(step[0]) if len(step) else min(high, nxt + PIECE_BYTES)
                end = nxt
        inner = offsets[(offsets > low) & (offsets < end)] - low
        hashes, starts, ends = _piece_words(data[low:end], inner, fold, marks)
        found.append((hashes, starts + low, ends + low))
        low = end
    hashes, starts, ends = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(starts, offsets)
    return (hashes, first, starts, ends) if spans else (hashes, first)


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first) of texts given as in words(); a text with fewer words has all of them as one shingle."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    total = np.zeros(begin[-1], np.uint64)
    last = len(hashes) - 1
    for j in range(width):
        total += hashes[np.minimum(at + j, last)] * _SHINGLE[j]
    for i in np.flatnonzero((n > 0) & (n < width)):
        own = hashes[first[i] : first[i + 1]]
        total[begin[i]] = (own * _SHINGLE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(total), begin


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    grams, begin = shingles(*words(data, offsets), width)
    return [np.unique(grams[begin[i] : begin[i + 1]]) for i in range(len(offsets) - 1)]


def text_slices(column: pa.Array, most: int = 4 * PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column in slices of about `most` bytes: (low, high, bytes, offsets)."""
    data, offsets = text_buffers(column)
    for low, high in sized_slices(offsets, most):
        yield low, high, data, offsets[low : high + 1]
