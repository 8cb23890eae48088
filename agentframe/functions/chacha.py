"""The exact sequential stream: ChaCha with 8 rounds, seeded from a 64-bit number, for simulations that must draw in order.

The key comes from the seed through a PCG generator, as the published stream-cipher crates do it; words are read low half first.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
# The PCG multiplier and increment, and the cipher's constant words.
_PCG_MUL, _PCG_INC = 6364136223846793005, 11634580027462260723
_CONSTANT = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
BLOCKS = 64


def seed_key(seed: int) -> list[int]:
    """Eight 32-bit key words from a 64-bit seed."""
    state, out = seed & _MASK, []
    for _ in range(8):
        state = (state * _PCG_MUL + _PCG_INC) & _MASK
        shifted, turn = (((state >> 18) ^ state) >> 27) & 0xFFFFFFFF, state >> 59
        out.append(((shifted >> turn) | (shifted << ((32 - turn) & 31))) & 0xFFFFFFFF)
    return out


def keystream(key: list[int], first: int, blocks: int) -> np.ndarray:
    """The 32-bit words of blocks first, first + 1, ..., worked out side by side."""
    counter = np.arange(first, first + blocks, dtype=np.uint64)
    start = [np.full(blocks, c, np.uint32) for c in (*_CONSTANT, *key)]
    start += [(counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), np.zeros(blocks, np.uint32), np.zeros(blocks, np.uint32)]
    x = [v.copy() for v in start]

    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return (v << np.uint32(n)) | (v >> np.uint32(32 - n))

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[p] = x[p] + x[q]
            x[r] = turn(x[r] ^ x[p], n)

    for _ in range(4):
        for k in range(4):
            quarter(k, 4 + k, 8 + k, 12 + k)
        for k in range(4):
            quarter(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4)
    return np.stack([v + s for v, s in zip(x, start, strict=True)], 1).reshape(-1)


class Stream:
    """Draws in order."""

    def __init__(self, seed: int):
        self.key, self.block = seed_key(seed), 0
        self.words: list[int] = []
        self.at = 0

    def u64(self) -> int:
        if self.at >= len(self.words):
            self.words = keystream(self.key, self.block, BLOCKS).view("<u8").tolist()
            self.block, self.at = self.block + BLOCKS, 0
        self.at += 1
        return self.words[self.at - 1]

    def below(self, bound: int) -> int:
        """Unbiased, by widening multiplication with rejection; 0 without a draw for bound 0."""
        if bound == 0:
            return 0
        wide = self.u64() * bound
        least = ((1 << 64) - bound) % bound
        while wide & _MASK < least:
            wide = self.u64() * bound
        return wide >> 64

    def f64(self) -> float:
        return (self.u64() >> 11) * 2.0**-53

    def chance(self, p: float) -> bool:
        return self.f64() < p

    def shuffle(self, items: list) -> None:
        for i in range(len(items) - 1, 0, -1):
            j = self.below(i + 1)
            items[i], items[j] = items[j], items[i]
