"""Vectorised text kernels over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, found in the UTF-8
bytes (the separators are ASCII, so bytes and characters agree).  Every word
becomes a 64-bit hash.  Texts are worked on in slices of a few megabytes, and
a text longer than a slice is cut at white space, so memory does not follow
the length of a text; only its 8 bytes a word do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def _words(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, hashes) of the words of ``data``; a word ends at each of ``breaks``."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = breaks[breaks < len(data)]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    at = np.cumsum(first) - 1
    pos = np.flatnonzero(inside)
    word = at[pos]
    lengths = np.bincount(word, minlength=len(starts))
    code = (_LOWER[data[pos]] if lower else data[pos]).astype(np.uint64) + np.uint64(1)
    code *= _power(int(lengths.max()))[pos - starts[word]]
    edge = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=edge[1:])
    return starts, lengths, mix(np.add.reduceat(code, edge) + lengths.astype(np.uint64))


def text_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a string column: (first row, words in each row, bytes, and each word's start in them, length and hash)."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1
        if end > row:
            base = offsets[row]
            part = data[base : offsets[end]]
            cuts = offsets[row : end + 1] - base
            starts, lengths, hashes = _words(part, cuts[:-1], lower)
            yield row, np.diff(np.searchsorted(starts, cuts, "left")), part, starts, lengths, hashes
            row = end
        else:
            part = data[offsets[row] : offsets[row + 1]]
            out = list(long_text_words(part, lower)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            starts, lengths, hashes = (np.concatenate(x) for x in zip(*out))
            yield row, np.array([len(hashes)]), part, starts, lengths, hashes
            row += 1


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a string column: (first row, words in each row, word hashes in order)."""
    for row, counts, _, _, _, hashes in text_words(column, lower):
        yield row, counts, hashes


def long_text_words(text: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, hashes) of the words of one text, piece by piece, cut at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            back = np.flatnonzero(SPACE[text[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one word longer than a slice
                ahead = np.flatnonzero(SPACE[text[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(text)
        starts, lengths, hashes = _words(text[at:end], np.zeros(1, np.int64), lower)
        yield starts + at, lengths, hashes
        at = end


def shingles(hashes: np.ndarray, counts: np.ndarray, words: int) -> list[np.ndarray]:
    """Distinct sorted shingle hashes of each row; a row of fewer words has its whole sequence as one."""
    n = len(hashes)
    if n >= words:
        roll = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            roll = mix(roll * np.uint64(0x9FB21C651E98DF25) + hashes[k : n - words + 1 + k])
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(roll[at : at + c - words + 1]))
        elif c:
            own = np.zeros(1, np.uint64)
            for k in range(c):
                own = mix(own * np.uint64(0x9FB21C651E98DF25) + hashes[at + k])
            out.append(mix(own + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
