"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is a dummy space and itself, with spaces written as the mark U+2581; marks stand only at the beginning of pieces or make up a whole piece, and no piece
holds a line end, so the lattice splits exactly into units: a run of spaces with what follows up to the next space or line end, of any length. Arcs are the vocabulary's pieces, with
weight ``(rank + 2) ** -theta`` (the model orders its pieces by merge rank), and, for characters that are no piece, their single bytes with a small weight, so that every text has a path. The forward pass sums the weights
of all paths to each place, as logarithms in units over ``UNIT`` bytes; the backward pass samples arcs from the end with their exact posterior probabilities. Each draw is a hash of the
row's key, the unit's number and the step, so a row gets the same pieces wherever it is computed; equal texts under other keys get other samples.

Decoding joins the pieces, turns marks into spaces and takes the dummy space off: it gives back the text, a literal U+2581 included, which
is only ever written as bytes. Null and empty texts have no pieces and decode to the empty text. Repeated rows get the same pieces. Texts of any length are encoded
whole; memory grows with the longest run without a space. An empty table gives no rows. Input columns with the name of an added one give way to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from agentframe.llm.common import BYTE_VALUES, mapped, mix64, powers, slices, text_buffers, without

UNIT, THETA, BYTE_WEIGHT, TEXT_BYTES = 40, 1.0, 1e-5, 4 << 20
_UNITS = re.compile(rb" *[^ \n]+| +|\n")
_MARK, _HIDDEN = b"\xe2\x96\x81", b"\xff\xfe\xfd"
#: Bytes of the character that a byte opens; the hidden bytes stand alone.
_WIDTHS = np.ones(256, np.int8)
_WIDTHS[0xC0:0xE0], _WIDTHS[0xE0:0xF0], _WIDTHS[0xF0:0xF8] = 2, 3, 4
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


class Vocabulary:
    """Pieces by hash in an open table, their weights, and the bytes that each stands for."""

    def __init__(self, path: str, theta: float = THETA):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.raw = [b""] * size
        weight = np.zeros(size)
        names: dict[bytes, int] = {}
        self.bytes = np.zeros(256, np.int64)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "▁" not in piece.lstrip("▁"):
                names[piece.encode()] = i
                weight[i] = (2.0 - model.get_score(i)) ** -theta
                self.raw[i] = piece.replace("▁", " ").encode()
        for shown, real in zip(_HIDDEN, _MARK, strict=True):
            self.bytes[shown] = self.bytes[real]
        self.weight = weight
        self.lengths = sorted({len(n) for n in names})
        self.bits = 20
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int64)
        self.maybe = np.zeros(1 << (self.bits + 2), bool)
        self.probes = 1
        for name, i in names.items():
            data = np.frombuffer(name, np.uint8)
            h = int(self.hashes(data, np.array([0]), np.array([len(data)]))[0])
            at, tries = h >> (64 - self.bits), 1
            while self.ids[at] >= 0:
                at, tries = (at + 1) % (1 << self.bits), tries + 1
            self.keys[at], self.ids[at] = h, i
            self.maybe[h >> (64 - self.bits - 2)] = True
            self.probes = max(self.probes, tries)

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None, back: np.ndarray | None = None) -> np.ndarray:
        if sums is None:
            sums, back = self.prefix(data)
        return ((sums[end] - sums[start]) * back[start] ^ (end - start).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)

    @staticmethod
    def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(_ODD, len(data)), out=sums[1:])
        return sums, powers(_BACK, len(data))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the hashes that are pieces, their pieces)."""
        some = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits - 2)).astype(np.int64)])
        h = h[some]
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        for _ in range(1, self.probes):
            at = (at + 1) & ((1 << self.bits) - 1)
            out = np.where((out < 0) & (self.keys[at] == h), self.ids[at], out)
        hit = out >= 0
        return some[hit], out[hit]


class Lattice:
    """Arcs into each place of many units side by side. Place numbers run through all units; arcs are sorted by their end. With logs, sums are held as logarithms."""

    def __init__(self, units: list[bytes], words: Vocabulary, logs: bool = False):
        shown = [u.replace(_MARK, _HIDDEN).replace(b" ", _MARK) for u in units]
        size = np.array([len(s) for s in shown], np.int64)
        data = np.frombuffer(b"".join(shown), np.uint8)
        self.first = np.cumsum(size + 1) - (size + 1)
        self.last = self.first + size
        begin = np.repeat(np.cumsum(size) - size, size)
        unit = np.repeat(np.arange(len(units)), size)
        offset = np.arange(len(data)) - begin
        left = np.repeat(size, size) - offset
        sums, back = words.prefix(data)
        opens = (data & 0xC0) != 0x80
        single = np.zeros(len(data), bool)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in words.lengths:
            s = np.flatnonzero(left >= n)
            hit, ids = words.find(words.hashes(data, s, s + n, sums, back))
            at = s[hit]
            found.append((n, at + n - 1, ids))
            if n <= 4:
                single[at[opens[at] & (_WIDTHS[data[at]] == n)]] = True
        known = single[np.maximum.accumulate(np.where(opens, np.arange(len(data)), 0))]
        alone = np.flatnonzero(~known)
        found.append((0, alone, words.bytes[data[alone]]))
        per = np.zeros(len(data), np.int64)
        for _, last, _ in found:
            per[last] += 1
        begin_arc = np.cumsum(per) - per
        fill, arcs = begin_arc.copy(), int(per.sum())
        self.ids, length, weight = np.zeros(arcs, np.int32), np.ones(arcs, np.int32), np.full(arcs, BYTE_WEIGHT)
        for n, last, ids in found:
            at = fill[last]
            fill[last] = at + 1
            self.ids[at] = ids
            if n:
                length[at], weight[at] = n, words.weight[ids]
        node = np.arange(1, len(data) + 1) + unit
        b = np.repeat(node, per)
        self.start = b - length
        forward = np.zeros(len(data) + len(units))
        forward[self.first] = 0 if logs else 1
        weight = np.log(weight) if logs else weight
        places = np.flatnonzero(per)
        places = places[np.argsort(offset[places] if logs else offset[places].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(offset[places], np.arange(int(offset.max(initial=-1)) + 2))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x < y:
                ends = places[x:y]
                heads = np.cumsum(per[ends]) - per[ends]
                own = np.arange(int(per[ends].sum())) + np.repeat(begin_arc[ends] - heads, per[ends])
                if logs:
                    paths = forward[self.start[own]] + weight[own]
                    best = np.maximum.reduceat(paths, heads)
                    forward[node[ends]] = best + np.log(np.add.reduceat(np.exp(paths - np.repeat(best, per[ends])), heads))
                else:
                    forward[node[ends]] = np.add.reduceat(forward[self.start[own]] * weight[own], heads)
        share = np.exp(forward[self.start] + weight - forward[b]) if logs else forward[self.start] * weight / forward[b]
        total = np.cumsum(share)
        head = np.repeat(begin_arc, per) - 1
        self.bound = b + np.minimum(total - np.where(head >= 0, total[head], 0), 1.0)
        self.arcs_first, self.arcs_end = np.zeros(len(forward), np.int64), np.zeros(len(forward), np.int64)
        self.arcs_first[node], self.arcs_end[node] = begin_arc, begin_arc + per - 1

    def sample(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count): pieces of each occurrence of a unit in order, and how many each has."""
        at, where, stop = self.last[unit], np.arange(len(unit)), self.first[unit]
        count = np.zeros(len(unit), np.int64)
        got: list[tuple[np.ndarray, np.ndarray, int]] = []
        step = 0
        while len(where):
            u = (mix64(seed[where] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc, end, u = self.arcs_first[at], self.arcs_end[at], at + u
            on = np.flatnonzero((self.bound[arc] <= u) & (arc < end))
            while len(on):
                arc[on] += 1
                on = on[(self.bound[arc[on]] <= u[on]) & (arc[on] < end[on])]
            got.append((where, self.ids[arc], step))
            count[where] += 1
            at = self.start[arc]
            go = at > stop[where]
            at, where = at[go], where[go]
            step += 1
        place = np.cumsum(count)
        out = np.zeros(int(count.sum()), np.int32)
        for w, ids, k in got:
            out[place[w] - 1 - k] = ids
        return out, count


_loaded: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, theta: float = THETA) -> Vocabulary:
    if (path, theta) not in _loaded:
        _loaded[path, theta] = Vocabulary(path, theta)
    return _loaded[path, theta]


def key_seeds(keys: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(k).encode()) for k in keys], np.uint64)


def encode_texts(texts: list[bytes], seeds: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the sampled pieces of each text."""
    units = [_UNITS.findall(b" " + t) if t else [] for t in texts]
    number = {u: i for i, u in enumerate(dict.fromkeys(chain.from_iterable(units)))}
    per = np.array([len(us) for us in units], np.int64)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(units)), np.int64, int(per.sum()))
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    index = np.arange(len(flat)) - np.repeat(np.cumsum(per) - per, per)
    seed = mix64(np.repeat(seeds, per) + index.astype(np.uint64) * np.uint64(_ODD))
    names, lattice = list(number), lambda some, logs: Lattice([names[i] for i in some.tolist()], words, logs)
    long = np.array([len(u) > UNIT for u in names], bool)
    if not long.any():
        ids, count = Lattice(names, words).sample(flat, seed)
    else:
        apart, rank = long[flat], np.where(long, np.cumsum(long), np.cumsum(~long)) - 1
        parts = [lattice(np.flatnonzero(long == logs), logs).sample(rank[flat[apart == logs]], seed[apart == logs]) for logs in (False, True)]
        count = np.zeros(len(flat), np.int64)
        count[~apart], count[apart] = parts[0][1], parts[1][1]
        from_long = np.repeat(apart, count)
        ids = np.zeros(len(from_long), np.int32)
        ids[~from_long], ids[from_long] = parts[0][0], parts[1][0]
    ends = np.concatenate([[0], np.cumsum(count)])
    return ids, ends[np.concatenate([[0], np.cumsum(per)])]


def decode_ids(ids: np.ndarray, words: Vocabulary) -> bytes:
    return b"".join(map(words.raw.__getitem__, ids.tolist()))[1:]


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", theta: float = THETA) -> DataFrame:
    """df with pieces: array of the sampled piece ids."""
    df = without(df, "pieces")
    k, t = df.columns.index(key), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, theta)
        for batch in batches:
            _, offsets = text_buffers(batch.column(t))
            for a, b in slices(offsets, TEXT_BYTES):
                part = batch.slice(a, b - a)
                ids, ends = encode_texts([(v.as_py() or "").encode() for v in part.column(t)], key_seeds(part.column(k).to_pylist()), words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=[*part.schema.names, "pieces"])

    return mapped(df, run, "pieces array<int>")


def decode(df: DataFrame, model: str, pieces: str = "pieces") -> DataFrame:
    """df with decoded: the text of its pieces."""
    df = without(df, "decoded")
    p = df.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            texts = [decode_ids(np.array(v.as_py() or [], np.int64), words).decode() for v in batch.column(p)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return mapped(df, run, "decoded string")


def round_trip(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", theta: float = THETA) -> DataFrame:
    """key, n_bytes, n_pieces, pieces_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and lossless for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, theta)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, TEXT_BYTES):
                part = batch.slice(a, b - a)
                texts = [(v.as_py() or "").encode() for v in part.column(1)]
                ids, ends = encode_texts(texts, key_seeds(part.column(0).to_pylist()), words)
                rows = []
                for i, t in enumerate(texts):
                    own = ids[ends[i] : ends[i + 1]]
                    back = decode_ids(own, words)
                    rows.append((len(t), len(own), zlib.crc32(own.astype("<u4").tobytes()), hashlib.sha256(back).hexdigest(), back == t))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k_) for c, k_ in zip(zip(*rows, strict=True), kinds, strict=True))], names=[key, "n_bytes", "n_pieces", "pieces_crc32", "decoded_sha256", "lossless"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_pieces long, pieces_crc32 long, decoded_sha256 string, lossless boolean")
