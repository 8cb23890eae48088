"""Counter-based random columns: every draw is a pure function of (seed, step, agent), so results do not depend on partitioning.

64-bit words are held in signed BIGINT. Spark's ANSI arithmetic has no wrapping product, so ``mul64`` works in 16- and 32-bit limbs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The SplitMix64 finaliser and its increment.
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def signed(value: int) -> int:
    """The signed 64-bit number with the bits of value."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def mul64(a: Column, factor: int) -> Column:
    """a * factor modulo 2 ** 64."""
    mask = F.lit((1 << 32) - 1)
    b = [F.lit((factor >> s) & 0xFFFF) for s in (0, 16, 32, 48)]
    a0, a1 = a.bitwiseAND(mask), F.shiftrightunsigned(a, 32)
    t1, t3 = a0 * b[1], a0 * b[3]
    low = a0 * b[0] + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(t1, 16) + (a0 * b[2]).bitwiseAND(mask) + F.shiftleft(t3.bitwiseAND(F.lit(0xFFFF)), 16)
    high = high + (a1 * b[0]).bitwiseAND(mask) + F.shiftleft((a1 * b[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def _once(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _fold(z: Column, shift: int) -> Column:
    return z.bitwiseXOR(F.shiftrightunsigned(z, shift))


def mix64(z: Column) -> Column:
    """SplitMix64's finaliser. Each stage is bound to a name, so z stands in the expression once."""
    return _once(z, lambda w: _once(mul64(_fold(w, 30), MIX_A), lambda y: _once(mul64(_fold(y, 27), MIX_B), lambda x: _fold(x, 31))))


def child_seed(seed: int, step: int | Column, agent: Column) -> Column:
    """The seed of an agent's own stream in one step. A step known beforehand costs nothing per row."""
    first = _python_mix64(seed ^ GOLDEN)
    if isinstance(step, int):
        return mix64(F.lit(signed(_python_mix64(first ^ step))).bitwiseXOR(agent))
    return mix64(mix64(F.lit(signed(first)).bitwiseXOR(step)).bitwiseXOR(agent))


def _python_mix64(z: int) -> int:
    mask = (1 << 64) - 1
    z = ((z ^ (z >> 30)) * MIX_A) & mask
    z = ((z ^ (z >> 27)) * MIX_B) & mask
    return z ^ (z >> 31)


def uniform(word: Column) -> Column:
    """A double in [0, 1) from the upper 53 bits."""
    return F.shiftrightunsigned(word, 11).cast("double") * F.lit(2.0**-53)


def below(word: Column, bound: Column) -> Column:
    """An integer in [0, bound), 0 for bound 0; the bias is under bound / 2 ** 53."""
    return F.when(bound <= 0, F.lit(0).cast("long")).otherwise(F.floor(uniform(word) * bound).cast("long"))


def bernoulli(word: Column, p: Column) -> Column:
    """True with probability p; an error for p outside [0, 1] or NaN."""
    valid = (p >= 0) & (p <= 1) & ~F.isnan(p)
    return F.when(valid, uniform(word) < p).otherwise(F.raise_error(F.lit("p outside [0, 1]")).cast("boolean"))


def normal(word: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """A normal deviate by Box and Muller from a word and a second word mixed from it."""
    u1 = F.greatest(uniform(word), F.lit(1e-300))
    u2 = uniform(mix64(word.bitwiseXOR(F.lit(signed(GOLDEN)))))
    return F.lit(mean) + F.lit(sd) * F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def draw(seed: int, step: Column, agent: Column, k: int = 0) -> Column:
    """The k-th word of an agent's stream in one step."""
    base = child_seed(seed, step, agent)
    return base if k == 0 else mix64(base.bitwiseXOR(F.lit(signed(k * GOLDEN))))
