"""SuperMinHash signatures of word shingles, in numpy over Arrow batches.

Each element of a set draws a random permutation of the m slots; its value in the j-th slot
of that permutation is j plus a uniform number, so an element takes every slot at another rank.
A slot keeps the least value. Values of rank j lie in [j, j+1): once every slot is below the
rank, later ranks change nothing and the loop stops. All elements step through the ranks
together, which gives the same minima as one element after another.
"""

from __future__ import annotations

import numpy as np

from sedgewire.llm.common import U64, hash_spans, lower_ascii, mix64, word_bounds

_GOLD = U64(0x9E3779B97F4A7C15)
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes, and where each text's begin.

    A text of 1 to k-1 words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(offsets) - 1
    base = offsets[0]
    piece = lower_ascii(data[base : offsets[-1]])
    at = offsets - base
    bounds = [word_bounds(piece[at[i] : at[i + 1]]) for i in range(n)]
    counts = np.array([len(b[0]) for b in bounds], dtype=np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    starts = np.concatenate([b[0] + at[i] for i, b in enumerate(bounds)])
    ends = np.concatenate([b[1] + at[i] for i, b in enumerate(bounds)])
    words = hash_spans(piece, starts, ends)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    chain = padded[k - 1 : k - 1 + len(words)]
    for j in range(k - 2, -1, -1):
        chain = mix64(padded[j : j + len(words)] + _GOLD * mix64(chain))
    out = []
    for i in range(n):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= k:
            s = np.sort(chain[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = U64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([w], np.uint64) + _GOLD * mix64(np.array([h], np.uint64)))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(s) for s in out])]).astype(np.int64)


def signatures(elements: np.ndarray, firsts: np.ndarray, m: int) -> np.ndarray:
    """A row of m slots for each set: rank << 56 | the leading 56 bits of the uniform number. Empty sets keep the greatest value."""
    n = len(firsts) - 1
    sizes = np.diff(firsts)
    owner = np.repeat(np.arange(n), sizes)
    best = np.full(n * m, _FULL, np.uint64)
    # rank 0 needs no permutation yet: the slot is the first draw
    value, draw = _draw(elements, 0)
    first = (draw % U64(m)).astype(np.int64)
    np.minimum.at(best, owner * m + first, value)
    best = best.reshape(n, m)
    sparse = np.flatnonzero((sizes > 0) & (best == _FULL).any(axis=1))
    at = 0
    while at < len(sparse):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[sparse[at:]]), 20_000, side="right")))
        _later_ranks(elements, firsts, sparse[at:to], best, first, m)
        at = to
    return best


def _draw(elements: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element at this rank: its value, and the number that picks its slot."""
    a = mix64(elements + U64(0x9E3779B97F4A7C15 * (2 * rank + 1) & 0xFFFFFFFFFFFFFFFF))
    b = mix64(elements ^ U64(0x9E3779B97F4A7C15 * (2 * rank + 2) & 0xFFFFFFFFFFFFFFFF))
    return (a >> U64(8)) | (U64(rank) << U64(56)), b >> U64(16)


def _later_ranks(elements, firsts, sets, best, first, m) -> None:
    """Ranks from 1 on for the sets with open slots; a set leaves when its last slot is taken."""
    index = np.concatenate([np.arange(firsts[s], firsts[s + 1]) for s in sets])
    owner = np.repeat(sets, firsts[sets + 1] - firsts[sets])
    x, rows = elements[index], np.arange(len(index))
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
    perm[rows, first[index]] = 0
    flat = best.reshape(-1)
    for rank in range(1, m):
        value, draw = _draw(x, rank)
        k = rank + (draw % U64(m - rank)).astype(np.int64)
        slot = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[:, rank]
        np.minimum.at(flat, owner * m + slot, value)
        stay = (best[owner] == _FULL).any(axis=1) if rank % 8 == 0 or rank < 4 else None
        if stay is not None and not stay.all():
            if not stay.any():
                break
            x, owner, perm = x[stay], owner[stay], perm[stay]
            rows = np.arange(len(x))
