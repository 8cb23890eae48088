"""Terms: the maximal runs of ASCII letters, digits and characters beyond ASCII of each text, with A-Z lower-cased; found in UTF-8 bytes, vectorised."""

from __future__ import annotations

import zlib

import numpy as np

from agentframe.llm.common import BYTE_VALUES, mix64, powers

_INSIDE = np.zeros(256, bool)
_INSIDE[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
#: Runs of more bytes are summed one by one.
LONG = 64


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms of each text, and the first term's number of each text (one more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] = inside[1:-1][cuts]
    closes[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each term of lower-cased bytes, as a signed integer; equal terms have equal hashes in all tasks."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(_ODD, len(data)), out=sums[1:])
    back = powers(_INV, len(data) + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
ALL_ONES = np.uint32(0xFFFFFFFF)


def crc_feed(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers (the check sum's complement) after data[start:end] of each run, byte places of all runs side by side."""
    out, lengths = register.copy(), ends - starts
    for i in np.flatnonzero(lengths > LONG):
        out[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~register[i])))
    lengths = np.where(lengths > LONG, 0, lengths)
    order = np.argsort(lengths, kind="stable")
    sizes, at, held = lengths[order], starts[order], out[order]
    for k in range(int(sizes[-1]) if len(sizes) else 0):
        a = int(np.searchsorted(sizes, k, "right"))
        held[a:] = _CRC[(held[a:] ^ data[at[a:] + k]) & 255] ^ (held[a:] >> np.uint32(8))
    out[order] = held
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to longest consecutive terms of a text, joined by one space, and the text each belongs to."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    register, at = np.full(len(starts), ALL_ONES), np.arange(len(starts))
    sums, owners = [], []
    for size in range(1, longest + 1):
        if size > 1:
            at = at[(at + size - 1 < len(starts)) & (owner[np.minimum(at + size - 1, len(starts) - 1)] == owner[at])] if len(at) else at
            register[at] = _CRC[(register[at] ^ np.uint32(32)) & 255] ^ (register[at] >> np.uint32(8))
        if len(at):
            register[at] = crc_feed(register[at], data, starts[at + size - 1], ends[at + size - 1])
        sums.append(~register[at])
        owners.append(owner[at])
    return np.concatenate(sums), np.concatenate(owners)
