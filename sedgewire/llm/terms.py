"""Terms of whole texts in numpy: runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sedgewire.llm.common import arrow_bytes, lower_ascii, slices

_TERM = np.zeros(256, bool)
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _TERM[_first : _last + 1] = True


@dataclass
class Terms:
    """Terms of some rows, or of a part of one long row. The first `fresh` terms count here; those behind them are met again in the next part."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    fresh: int


def term_bounds(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in these bytes; no term goes over a break."""
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] = inside[breaks]
    last[breaks - 1] = inside[breaks - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def terms_of(column: pa.Array, most: int = 4 << 20, overlap: int = 0) -> Iterator[Terms]:
    """The terms of a string column, in pieces of about `most` bytes. A longer text comes in parts cut between terms; the last `overlap` terms of a part begin the next one. Nulls have none."""
    data, offsets = arrow_bytes(column)
    for at, to in slices(offsets, most):
        begin, end = int(offsets[at]), int(offsets[to])
        if end - begin <= most or to - at > 1:
            piece, breaks = lower_ascii(data[begin:end]), offsets[at : to + 1] - begin
            starts, ends = term_bounds(piece, breaks)
            yield Terms(piece, starts, ends, at + np.searchsorted(breaks, starts, side="right") - 1, len(starts))
            continue
        size = most
        while begin < end:
            to_ = min(begin + size, end)
            piece = lower_ascii(data[begin:to_])
            starts, ends = term_bounds(piece, np.zeros(0, np.int64))
            n = len(starts) - int(to_ < end and len(ends) > 0 and ends[-1] == len(piece))  # one that touches the cut may go on
            if to_ < end and n <= overlap:
                if len(starts):
                    size *= 2
                else:
                    begin = to_
                continue
            yield Terms(piece, starts[:n], ends[:n], np.full(n, at), n if to_ == end else n - overlap)
            begin, size = (end if to_ == end else begin + int(starts[n - overlap] if overlap else ends[n - 1])), most
