"""Count transducers: weighted acyclic automata of word sequences of at most four words.

An automaton is kept by depth.  Depth d holds one arc for each distinct sequence of d labels, in order: its label, its weight
(how often a counted sequence begins with these labels) and where its arcs of the next depth begin.  Labels are numbers of a
word list; label 0 ends a sequence early.  Built from sorted sequences in one sweep: an arc is new exactly where a sequence
leaves the path of the one before it.
"""

from __future__ import annotations

import numpy as np

DEPTH = 4


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds all values."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def build(paths: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, weights, children) of each depth from sorted rows of DEPTH labels; children is the number of arcs below an arc."""
    levels, heads = [], None
    leaves = np.zeros(len(paths), bool)
    leaves[:1] = True
    for d in range(DEPTH):
        leaves[1:] |= paths[1:, d] != paths[:-1, d]
        new = np.flatnonzero(leaves)
        if heads is not None:
            levels[-1][2] = np.diff(np.append(np.searchsorted(new, heads), len(new)))
        levels.append([paths[new, d], np.add.reduceat(weights, new) if len(new) else weights[:0], np.zeros(len(new), np.int64)])
        heads = new
    return [tuple(x) for x in levels]


def expand(levels) -> tuple[np.ndarray, np.ndarray]:
    """The sorted rows of labels and weights that `build` was given, equal rows added up."""
    n, columns = len(levels[-1][0]), [levels[-1][0]]
    whole = np.arange(n + 1)  # how many whole paths lie before each arc of the depth below
    for labels, _, children in levels[-2::-1]:
        whole = whole[np.concatenate([[0], np.cumsum(children)])]
        columns.append(np.repeat(labels, np.diff(whole)))
    return np.stack(columns[::-1], axis=1), levels[-1][1]


def union(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One automaton of (rows of labels, weights) with the same word list; weights of equal rows are added."""
    paths, weights = np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])
    order = sorted_rows(paths)
    return build(paths[order], weights[order])


def sorted_rows(paths: np.ndarray) -> np.ndarray:
    """Order of the rows by first, second, third and fourth label."""
    bits = int(paths.max()).bit_length() if paths.size else 1
    if bits * DEPTH <= 64:
        key = np.zeros(len(paths), np.uint64)
        for d in range(DEPTH):
            key = (key << np.uint64(bits)) | paths[:, d].astype(np.uint64)
        return np.argsort(key, kind="stable")
    left = (paths[:, 0].astype(np.uint64) << np.uint64(32)) | paths[:, 1].astype(np.uint64)
    right = (paths[:, 2].astype(np.uint64) << np.uint64(32)) | paths[:, 3].astype(np.uint64)
    return np.lexsort([right, left])


def to_bytes(levels, words: list[bytes]) -> bytes:
    """The automaton with the words that its labels 1, 2, ... number."""
    arrays = [np.frombuffer(b"".join(words), np.uint8), small(np.array([len(w) for w in words], np.int64))]
    for labels, weights, children in levels:
        arrays += [small(labels), small(weights), small(children)]
    head = np.array([[a.itemsize, len(a)] for a in arrays], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def from_bytes(blob: bytes):
    """(levels, words) of `to_bytes`."""
    n = 2 + 3 * DEPTH
    head, at, arrays = np.frombuffer(blob, np.int64, 2 * n).reshape(n, 2), 16 * n, []
    for size, length in head.tolist():
        arrays.append(np.frombuffer(blob, f"u{size}", length, at))
        at += size * length
    text, ends = arrays[0].tobytes(), np.cumsum(arrays[1].astype(np.int64)).tolist()
    words = [text[a:b] for a, b in zip([0, *ends], ends)]
    return [tuple(a.astype(np.int64) for a in arrays[i:i + 3]) for i in range(2, n, 3)], words
