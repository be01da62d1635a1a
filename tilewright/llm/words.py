"""Words and word shingles of many texts at once: numpy over the bytes of an Arrow batch, no loop over characters.

A word is a maximal run of bytes that are neither a space nor 0x09-0x0D; A-Z count as a-z.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text worked on at once; a longer text is a chunk of its own
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about `size` bytes of text, each with its bytes and offsets."""
    data, at = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words begin in that list (n + 1 offsets)."""
    letter = ~_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] = letter[edge]  # a text never goes on in the next one
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    back = at[1:-1][(at[1:-1] > 0)] - 1
    if len(data):
        last[back] = letter[back]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    cut = np.cumsum(lens) - lens
    inside = np.arange(int(lens.sum())) - np.repeat(cut, lens)
    values = (_LOWER[data[np.repeat(starts, lens) + inside]] + np.uint64(1)) * powers(int(lens.max()))[inside]
    return mix(np.add.reduceat(values, cut) + lens.astype(np.uint64) * np.uint64(_BASE))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, end to end, and the n + 1 offsets of the texts in them.

    A text with fewer words than `width` (at most 5) has its whole word sequence as one shingle; one without words has none.
    """
    starts, ends, first = word_spans(data, at)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes)
    out, sizes = [], np.zeros(len(at) - 1, np.int64)
    full = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        full[:n - k] += hashes[k:] * _STEPS[k]
    full = mix(full)
    for i in range(len(at) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= width:
            part = np.sort(full[lo:hi - width + 1])
            keep = np.ones(len(part), bool)
            keep[1:] = part[1:] != part[:-1]
            part = part[keep]
        elif hi > lo:
            part = mix((hashes[lo:hi] * _STEPS[:hi - lo]).sum(keepdims=True) ^ np.uint64(hi - lo))
        else:
            continue
        out.append(part)
        sizes[i] = len(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
