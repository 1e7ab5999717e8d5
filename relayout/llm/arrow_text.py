"""Words and their hashes over Arrow text batches, without a Python loop per word.

All functions work on the UTF-8 bytes of many texts at once. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of array work looks at; a longer text is cut at white space.
BLOCK = 1 << 20

_MASK = (1 << 64) - 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread over all bits."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)
_BASE = 0x2545F4914F6CDD1D
_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the (odd) base, and of its inverse modulo 2^64."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, BLOCK + 1)
        _UP = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
        down = pow(_BASE, -1, 1 << 64)
        _DOWN = np.concatenate([[np.uint64(1)], np.full(size - 1, down, np.uint64)]).cumprod(dtype=np.uint64)
    return _UP[:n], _DOWN[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8 for texts) and the n+1 offsets of a text or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that cut no word: at white space or between texts."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + limit, n)
        if end < n:
            cut = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            white = np.flatnonzero(_WHITE[data[start:end]])
            cut = max(cut, start + int(white[-1]) + 1 if len(white) else start)
            if cut <= start:  # one long word: up to its end
                cut = int(offsets[np.searchsorted(offsets, end, "left")])
                step = limit
                for at in range(end, cut, step):
                    white = np.flatnonzero(_WHITE[data[at : min(at + step, cut)]])
                    if len(white):
                        cut = at + int(white[0]) + 1
                        break
            end = cut
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z as a-z, in order; and the number of words before each text."""
    hashes, texts = [], []
    for a, b in blocks(data, offsets):
        part = data[a:b]
        solid = ~_WHITE[part]
        first = np.zeros(b - a, bool)
        inner = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        first[inner] = True
        first[0] = True
        start = np.flatnonzero(solid & (first | ~np.concatenate([[False], solid[:-1]])))
        last = np.concatenate([first[1:], [True]])
        end = np.flatnonzero(solid & (last | ~np.concatenate([solid[1:], [False]]))) + 1
        up, down = _powers(b - a)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_LOWER[part]] * up, dtype=np.uint64)])
        hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        texts.append(np.searchsorted(offsets, start + a, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    counts = np.bincount(np.concatenate(texts), minlength=len(offsets) - 1)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def shingle_sets(hashes: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and the number of them before each text.

    A text with fewer than ``size`` words has its whole sequence as one shingle; without words, none.
    """
    n = len(words) - 1
    count = np.diff(words)
    owner = np.repeat(np.arange(n), count)
    at = np.arange(len(hashes)) - words[owner] if len(hashes) else np.zeros(0, np.int64)
    whole = (at + size <= count[owner]) if len(hashes) else np.zeros(0, bool)
    start = np.flatnonzero(whole)
    rolled = np.full(len(start), 0x51ED270B1A2F3C4D + size, np.uint64)
    for step in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[start + step]
    key, text = [mix(rolled, 3)], [owner[start]]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        rolled = np.full(len(short), 0x51ED270B1A2F3C4D, np.uint64)
        for step in range(size):
            inside = step < count[short]
            word = hashes[np.minimum(words[short] + step, len(hashes) - 1)]
            rolled = np.where(inside, rolled * np.uint64(0x9E3779B97F4A7C15) + word, rolled)
        key.append(mix(rolled, 5))
        text.append(short)
    key, text = np.concatenate(key), np.concatenate(text)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
        key, text = key[new], text[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int64)
