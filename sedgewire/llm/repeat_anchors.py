"""Anchors of 200-byte windows, so that equal windows meet without shuffling each one.

Every window has one anchor: its 32-byte piece with the least hash, the leftmost of equals. Equal windows have
the same piece as anchor at the same distance. The windows of a text that share an anchor start next to each
other, so an anchor stands for a run of starts and the segment of bytes that those windows cover.
"""

from __future__ import annotations

import numpy as np

from sedgewire.llm.common import U64, mix64

PIECE = 32
_CHUNK = 1 << 19
_CODES = mix64(np.arange(1001, 1257, dtype=np.uint64))
_BASE = 0xB492B66FBE98F273
_UP = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(_CHUNK + 1024, _BASE, np.uint64)]))
_DOWN = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(_CHUNK + 1024, pow(_BASE, -1, 1 << 64), np.uint64)]))


def anchors(data: np.ndarray, window: int = 200) -> tuple[np.ndarray, ...]:
    """Of one text's bytes: anchor hash, segment hash, first start and number of starts of each run, in order, and where in the run's bytes the anchor stands.

    Texts are worked through in chunks of starts; a run that a chunk's end cuts becomes two.
    """
    parts = [_chunk(data[at : at + _CHUNK + window - 1], at, window) for at in range(0, max(0, len(data) - window + 1), _CHUNK)]
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _chunk(data: np.ndarray, at: int, window: int):
    codes = _CODES[data]
    h, step = codes, 1
    while step < PIECE:
        h = (h[:-step] ^ (h[:-step] >> U64(29))) * U64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:]
        step *= 2
    h = mix64(h)
    n = len(h)
    least = (h & U64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
    width, span = 1, window - PIECE + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    where = (least & U64(0xFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
    counts = np.diff(np.concatenate([begins, [len(where)]]))
    sums = np.concatenate([[U64(0)], np.cumsum(codes * _UP[: len(codes)], dtype=np.uint64)])
    ends = begins + counts + window - 1
    segment = mix64((sums[ends] - sums[begins]) * _DOWN[begins])
    segment = mix64(segment + counts.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + (where[begins] - begins).astype(np.uint64))
    return h[where[begins]], segment, begins + at, counts, where[begins] - begins



def halves(raw: bytes, n: int, offset: int, low: int, high: int, window: int = 200):
    """Cut a run whose windows have their anchor at a distance of low to high (both included) in two, by distance.

    Yields (low, high, core, first start, number of starts, offset, bytes) of each half that has windows; core is
    the bytes that all windows with that anchor at these distances share, so equal windows have equal cores. At one distance the core is the window.
    """
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        first, last = max(0, offset - b), min(n - 1, offset - a)
        if a <= b and first <= last:
            core = raw[offset - a : offset - b + window]
            yield a, b, core, first, last - first + 1, offset - first, raw[first : last + window]
