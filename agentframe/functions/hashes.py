"""Digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentframe.functions.rng import mul64, signed

# The offset basis and the prime of FNV-1a with 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a digest of a string's UTF-8 bytes or of a binary column, as a signed number."""
    raw = text.cast("binary")
    value = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("long")
    places = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>"))
    bytes_ = F.transform(places, value)
    step = lambda h, b: F.transform(F.array(h.bitwiseXOR(b)), lambda z: mul64(z, FNV_PRIME))[0]
    return F.aggregate(bytes_, F.lit(signed(FNV_BASIS)), step)
