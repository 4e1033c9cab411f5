"""A run-compressed Burrows-Wheeler index of some byte strings, and the matching statistics of the strings against each other.

Two suffixes that are neighbours in the suffix array and preceded by one byte stay neighbours when
that byte is put in front. So along the text the length that a suffix shares with its
neighbour falls by one from each position to the next, except where a run of the transform begins
(for the neighbour before) or ends (for the neighbour behind). Only those run ends are sampled and compared
byte by byte; streaming over the text gives all other lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_PACK, _BITS = 7, 9  # symbols to a key: byte + 1, with 0 behind the end of a string


@dataclass
class RunLengthIndex:
    starts: np.ndarray  # where each string starts; a separator of its own follows each string
    symbols: np.ndarray
    run_bytes: np.ndarray  # the transform's runs: symbol and first rank
    run_firsts: np.ndarray
    head_samples: np.ndarray  # text position at each run's first and last rank, and what it shares with the neighbour beyond
    head_lengths: np.ndarray
    tail_samples: np.ndarray
    tail_lengths: np.ndarray

    def matching(self) -> np.ndarray:
        """For each position the length of the longest match that starts there and also starts at another position."""
        n = len(self.symbols)
        out = np.zeros(n, np.int64)
        for samples, lengths in ((self.head_samples, self.head_lengths), (self.tail_samples, self.tail_lengths)):
            at = np.full(n, -1, np.int64)
            at[samples] = samples
            value = np.zeros(n, np.int64)
            value[samples] = lengths
            last = np.maximum.accumulate(at)
            out = np.maximum(out, np.where(last >= 0, value[last] - (np.arange(n) - last), 0))
        return out


def _suffix_array(symbols: np.ndarray, owner: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Prefix doubling from keys of 7 symbols; only suffixes that still share a rank are sorted again."""
    n = len(symbols)
    order = np.argsort(packed, kind="stable")
    rank = _ranks(order, packed[order])
    # a suffix that ends within its key is told apart by its string: separators are ordered
    short = (packed & ((1 << _BITS) - 1)) == 0
    step = _PACK
    key = rank << 32
    key[short] |= owner[short] + 1
    active = _shared(order, rank)
    first = True
    while len(active):
        if not first:
            nearby = np.minimum(active + step, n - 1)
            keys = rank[active] << 32 | np.where(active + step < n, rank[nearby] + 1, 0)
            step *= 2
        else:
            keys, first = key[active], False
        at = np.argsort(keys, kind="stable")
        part, sorted_keys = active[at], keys[at]
        slots = np.sort(rank[active], kind="stable")  # equal ranks are the first slot of their group
        change = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        groups = np.concatenate([[True], slots[1:] != slots[:-1]])
        position = np.arange(len(part))
        base = slots + position - np.maximum.accumulate(np.where(groups, position, 0))
        new = base[np.maximum.accumulate(np.where(change, position, 0))]
        rank[part] = new
        order[base] = part
        alone = change & np.concatenate([change[1:], [True]])
        active = part[~alone]
    return order


def _ranks(order: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    position = np.arange(len(order))
    change = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, position, 0))
    return rank


def _shared(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    r = rank[order]
    same = r[1:] == r[:-1]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]


def _common(packed: np.ndarray, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Symbols in common from a and b on, up to `most` or the end of a string."""
    out = np.zeros(len(a), np.int64)
    n = len(packed)
    active = np.arange(len(a))
    for k in range(0, most, _PACK):
        x, y = a[active] + k, b[active] + k
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        p, q = packed[x], packed[y]
        full = (p == q) & ((p & ((1 << _BITS) - 1)) != 0)
        rest, x, y = active[~full], x[~full], y[~full]
        same = np.ones(len(rest), bool)
        for j in range(_PACK):
            u, v = np.minimum(x + j, n - 1), np.minimum(y + j, n - 1)
            same &= (symbols[u] == symbols[v]) & (symbols[u] > 0) & (x + j < n) & (y + j < n)
            out[rest] += same
        active = active[full]
        out[active] += _PACK
        if not len(active):
            break
    return np.minimum(out, most)


def build(strings: list[bytes]) -> RunLengthIndex:
    """Index some strings (any bytes); matches end with the strings."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    symbols = np.zeros(int(sizes.sum()), np.int64)
    text = np.ones(len(symbols), bool)
    text[starts + sizes - 1] = False
    symbols[text] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(strings)), sizes)
    ends = np.repeat(starts + sizes - 1, sizes)
    room = ends - np.arange(len(symbols))  # symbols before the separator
    padded = np.concatenate([symbols, np.zeros(_PACK, np.int64)])
    packed = np.zeros(len(symbols), np.int64)
    for j in range(_PACK):
        packed = packed << _BITS | np.where(room > j, padded[j : j + len(symbols)], 0)
    order = _suffix_array(symbols, owner, packed)
    before = symbols[order - 1]  # of position 0: the last separator
    change = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])  # each separator is a symbol of its own
    heads = np.flatnonzero(change)
    tails = np.concatenate([heads[1:], [len(order)]]) - 1
    shared = np.concatenate([[0], _common(packed, symbols, order[heads[1:]], order[heads[1:] - 1], int(sizes.max()))]) if len(heads) else np.zeros(0, np.int64)
    return RunLengthIndex(starts, symbols, before[heads], heads, order[heads], shared, order[tails], np.concatenate([shared[1:], [0]]))
