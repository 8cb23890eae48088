"""Super-windows: the runs of consecutive windows of a fixed number of symbols that share a minimiser, with a digest, vectorised."""

from __future__ import annotations

import numpy as np

from agentframe.llm.common import mix64, powers

_ODD = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def super_windows(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, rel, anchor, digest) of each run of windows with one minimiser, which lies rel symbols after start.

    values has a 64-bit value for each symbol of the texts, 2 ** 24 at most. A window's minimiser is its string of gram symbols with the least hash, the leftmost of
    equals, so equal windows have equal minimisers at equal places, wherever they stand. start is counted from the text's first symbol; anchor is the
    minimiser's hash.
    """
    n, span = len(values), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_ODD, n), out=sums[1:])
    back = powers(pow(_ODD, -1, 1 << 64), n)
    grams = mix64((sums[gram:] - sums[: n - gram + 1]) * back[: n - gram + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & _LOW).astype(np.int64)
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - length + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    if not len(owner):
        return none
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][owner]
    p = place[at]
    first = np.ones(len(at), bool)
    first[1:] = (p[1:] != p[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(first)
    count = np.diff(np.concatenate([head, [len(at)]]))
    start, end = at[head], at[head] + count + length - 1
    one = mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return owner[head], start - offsets[:-1][owner[head]], count, p[head] - start, grams[p[head]].view(np.int64), one.view(np.int64)
