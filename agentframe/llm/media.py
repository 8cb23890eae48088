"""Media columns: signature sniffing with an Aho-Corasick automaton, structure validators, carving, and lossless sample storage.

``sniff`` looks at binary values. The automaton finds every place of a magic number in one pass; the validator of that
format then walks the structure (chunk lengths, check sums, end marks) and gives the length of the object, or nothing. An object
at offset 0 sets the true type; any other valid object outside it is carved. Null counts as an empty value, whose type is
``application/octet-stream``. Overlapping objects go to the earliest, then longest; hits inside an accepted object are not walked. Every place of a chain is walked once and end marks are looked up once a
value, so time grows with the value's length. Repeated rows get the same result; an empty table gives no rows. Input columns with the name of an added one give way to it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agentframe.llm.common import mapped, without

RATE, BLOCK = 8000, 576

# Magic numbers of public formats, with the distance of the magic number from the start of the object.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "audio/wav"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"P5\n", 0, "image/x-portable-graymap"),
    (b"WEBP", 8, "image/webp"),
    (b"OggS", 0, "application/ogg"),
    (b"ftyp", 4, "video/mp4"),
]


class Value(bytes):
    """A value with what is known of the chains that were walked in it: each place is walked once, wherever the walk began."""

    def known(self, kind: str) -> dict:
        return self.__dict__.setdefault(kind, {})

    def crc(self, a: int, b: int) -> int:
        """CRC-32 of self[a:b]; of long ranges from running sums, so ranges that overlap cost no more than others."""
        if b - a <= 2 * _CRC_STEP:
            return zlib.crc32(self[a:b])
        if "sums" not in self.__dict__:
            self.sums = [0]
            for k in range(0, len(self) - _CRC_STEP, _CRC_STEP):
                self.sums.append(zlib.crc32(self[k : k + _CRC_STEP], self.sums[-1]))
        upto = lambda p: zlib.crc32(self[p // _CRC_STEP * _CRC_STEP : p], self.sums[p // _CRC_STEP])
        return upto(b) ^ _crc_shifted(upto(a), b - a)


_CRC_STEP = 4096


def _apply(columns: list[int], v: int) -> int:
    out = 0
    for c in columns:
        if v & 1:
            out ^= c
        v >>= 1
        if not v:
            break
    return out


def _zero_bytes() -> list[list[int]]:
    """The effect on a CRC-32 of 1, 2, 4, ... bytes 0 behind what it sums, as columns over its bits."""
    bit = [0xEDB88320, *(1 << k for k in range(31))]
    powers = [bit]
    for _ in range(3 + 32):
        powers.append([_apply(powers[-1], c) for c in powers[-1]])
    return powers[3:]


_ZERO_BYTES = _zero_bytes()


def _crc_shifted(crc: int, n: int) -> int:
    k = 0
    while n:
        if n & 1:
            crc = _apply(_ZERO_BYTES[k], crc)
        n >>= 1
        k += 1
    return crc


def _end_of(known: dict, p: int, step) -> int | None:
    """Where the chain from p ends well: step gives the next place, or a tuple with the end or None."""
    path = []
    while p not in known:
        path.append(p)
        p = step(p)
        if isinstance(p, tuple):
            end = p[0]
            break
    else:
        end = known[p]
    known.update(dict.fromkeys(path, end))
    return end


def _png(b: Value, at: int) -> int | None:
    def step(p: int) -> int | tuple:
        if p + 12 > len(b):
            return (None,)
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if p + 12 + n > len(b) or b.crc(p + 4, p + 8 + n) != struct.unpack(">I", b[p + 8 + n : p + 12 + n])[0]:
            return (None,)
        return (p + 12 + n,) if kind == b"IEND" else p + 12 + n

    end = _end_of(b.known("png"), at + 8, step)
    return None if end is None else end - at


def _gif(b: Value, at: int) -> int | None:
    if at + 13 > len(b):
        return None

    def blocks(p: int) -> int | tuple:
        """Over the sub-blocks from p."""
        return (None,) if p >= len(b) else p + b[p] + 1 if b[p] else (p + 1,)

    def step(p: int) -> int | tuple:
        if p >= len(b):
            return (None,)
        if b[p] == 0x3B:
            return (p + 1,)
        if b[p] == 0x2C and p + 10 < len(b):
            first = p + 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
        elif b[p] == 0x21:
            first = p + 2
        else:
            return (None,)
        after = _end_of(b.known("gif blocks"), first, blocks)
        return (None,) if after is None else after

    end = _end_of(b.known("gif"), at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), step)
    return None if end is None else end - at


_JPEG_MARK = re.compile(rb"\xff(?=[^\x00\xd0-\xd7])", re.DOTALL)


def _jpeg(b: Value, at: int) -> int | None:
    """Segments by their lengths; after a scan's head its coded bytes, up to the next mark that is neither a stuffed byte nor a restart. Marks are looked up once a value."""

    def step(state: tuple[int, bool]) -> tuple:
        p, scanned = state
        if p + 2 > len(b) or b[p] != 0xFF:
            return None, True
        kind = b[p + 1]
        if kind == 0xD9:
            return (p + 2 if scanned else None), True
        if kind < 0xC0 or p + 4 > len(b) or (n := struct.unpack(">H", b[p + 2 : p + 4])[0]) < 2:
            return None, True
        if kind != 0xDA:
            return (p + 2 + n, scanned), False
        marks = b.known("jpeg marks")
        if not marks:
            marks["at"] = [m.start() for m in _JPEG_MARK.finditer(b)]
        k = bisect_left(marks["at"], p + 2 + n)
        return ((marks["at"][k], True), False) if k < len(marks["at"]) else (None, True)

    known, path, state = b.known("jpeg"), [], (at + 2, False)
    while state not in known:
        path.append(state)
        state, last = step(state)
        if last:
            end = state
            break
    else:
        end = known[state]
    known.update(dict.fromkeys(path, end))
    return None if end is None else end - at


def _webp(b: bytes, at: int) -> int | None:
    if b[at : at + 4] != b"RIFF" or at + 20 > len(b) or b[at + 12 : at + 16] not in (b"VP8 ", b"VP8L", b"VP8X"):
        return None
    n = 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
    return n if n >= 20 and at + n <= len(b) else None


def _ogg(b: Value, at: int) -> int | None:
    """Pages of one stream by their segment tables, from the one that begins it to the one that ends it."""

    def step(p: int) -> int | tuple:
        if p + 27 > len(b) or b[p : p + 5] != b"OggS\0":
            return (None,)
        end = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        if end > len(b):
            return (None,)
        return (end,) if b[p + 5] & 4 else end if b[end + 14 : end + 18] == b[p + 14 : p + 18] else (None,)

    if at + 27 > len(b) or not b[at + 5] & 2:
        return None
    end = _end_of(b.known("ogg"), at, step)
    return None if end is None else end - at


def _mp4(b: Value, at: int) -> int | None:
    """Boxes by their lengths, as far as they go; there must be one of type moov."""
    known, path, p = b.known("mp4"), [], at
    while p not in known:
        n, kind = struct.unpack(">I4s", b[p : p + 8]) if p + 8 <= len(b) else (0, b"")
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack(">Q", b[p + 8 : p + 16])[0]
        if n < 8 or p + n > len(b) or not kind.isalnum():
            known[p] = (p, False)
            break
        path.append((p, kind == b"moov"))
        p += n
    end, moov = known[p]
    for place, found in reversed(path):
        moov = moov or found
        known[place] = (end, moov)
    return end - at if moov else None


def _wav(b: Value, at: int) -> int | None:
    """Chunks by their lengths up to the data, which a format chunk must describe, all within the stated length."""
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
    if end > len(b):
        return None
    known, path, p = b.known("wav"), [], at + 12
    while p not in known:
        kind, n = struct.unpack("<4sI", b[p : p + 8]) if p + 8 <= len(b) else (b"", 0)
        if not kind or p + 8 + n > len(b):
            known[p] = (None, None)
        elif kind == b"data":
            known[p] = (p + 8 + n, None)
        else:
            described = None
            if kind == b"fmt ":
                code, channels, _, _, block = struct.unpack("<HHIIH", b[p + 8 : p + 22]) if n >= 16 else (0,) * 5
                described = code > 0 and channels > 0 and block > 0
            path.append((p, described))
            p += 8 + n + n % 2
    data, last = known[p]
    for place, described in reversed(path):
        last = described if last is None else last
        known[place] = (data, last)
    return end - at if data is not None and data <= end and last else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    n, zero, start, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    return n if zero == 0 and header in (12, 40, 108, 124) and 14 + header <= start <= n <= len(b) - at else None


_PDF_HEAD, _PDF_END = re.compile(rb"%PDF-"), re.compile(rb"startxref\s+(\d{1,19})\s+%%EOF")
_PDF_TABLE = re.compile(rb"xref|\d+\s+\d+\s+obj")


def _pdf_lengths(b: bytes) -> dict[int, int]:
    """The length of each PDF by its start: up to its last end mark, of as many revisions as it has, whose table stands where it is said to."""
    heads = [m.start() for m in _PDF_HEAD.finditer(b)]
    out = {}
    for m in _PDF_END.finditer(b) if heads else ():
        at = heads[bisect_right(heads, m.start()) - 1] if heads[0] < m.start() else None
        if at is not None and int(m[1]) < m.start() - at and _PDF_TABLE.match(b, at + int(m[1])):
            out[at] = m.end() - at
    return out


def _zip_lengths(b: bytes) -> dict[int, int]:
    """The length of each ZIP by its start, which its end record implies: the directory lies before the record, the comment behind it."""
    out, end = {}, b.find(b"PK\x05\x06")
    while 0 <= end <= len(b) - 22:
        entries, size, offset, comment = struct.unpack("<HIIH", b[end + 10 : end + 22])
        at = end - size - offset
        if at >= 0 and end + 22 + comment <= len(b) and (entries == 0 or b[at + offset : at + offset + 4] == b"PK\x01\x02"):
            out.setdefault(at, end + 22 + comment - at)
        end = b.find(b"PK\x05\x06", end + 4)
    return out


def _pgm(b: bytes, at: int) -> int | None:
    head = b[at + 3 : at + 40].split(b"\n", 2)
    if len(head) < 3 or head[1] != b"255" or len(size := head[0].split(b" ")) != 2 or not all(x.isdigit() for x in size):
        return None
    n = 3 + len(head[0]) + 5 + int(size[0]) * int(size[1])
    return n if at + n <= len(b) else None


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "image/bmp": _bmp, "image/x-portable-graymap": _pgm, "image/webp": _webp, "application/ogg": _ogg, "video/mp4": _mp4}
#: Formats whose ends are looked up once for all of a value.
ENDS = {"application/pdf": _pdf_lengths, "application/zip": _zip_lengths}


def wav_samples(b: bytes) -> bytes | None:
    """The data chunk of a RIFF WAVE value of 8-bit mono samples, found by walking its chunks."""
    p, pcm = 12, False
    while p + 8 <= len(b):
        kind, n = struct.unpack("<4sI", b[p : p + 8])
        if p + 8 + n > len(b):
            return None
        if kind == b"fmt " and n >= 16:
            code, channels, _, _, _, bits = struct.unpack("<HHIIHH", b[p + 8 : p + 24])
            pcm = (code, channels, bits) == (1, 1, 8)
        if kind == b"data":
            return b[p + 8 : p + 8 + n] if pcm else None
        p += 8 + n + n % 2
    return None


def wav_of(samples: bytes) -> bytes:
    """RIFF WAVE, PCM, mono, 8 bits; an even number of samples needs no pad byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def signature_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, before, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), before, kind))
    found.make_automaton()
    return found


def objects(value: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, length, type) of the valid, non-overlapping media objects in value."""
    value = Value(value)
    hits = [(last + 1 - size - before, kind) for last, (size, before, kind) in automaton.iter(value.decode("latin-1"))]
    lengths: dict[str, dict[int, int]] = {}
    out, end = [], 0
    for start, kinds in groupby(sorted(h for h in hits if h[0] >= 0), key=lambda h: h[0]):
        if start < end:
            continue
        found = []
        for _, kind in kinds:
            if kind in ENDS and kind not in lengths:
                lengths[kind] = ENDS[kind](value)
            n = lengths[kind].get(start) if kind in ENDS else VALIDATORS[kind](value, start)
            if n:
                found.append((n, kind))
        if found:
            n, kind = max(found)
            out.append((start, n, kind))
            end = start + n
    return out


def sniffed(value: bytes, declared: str | None, automaton: ahocorasick.Automaton) -> tuple[str, int, bool, list[tuple[int, int, str]]]:
    """(true type, length of the object at the start or of the value, whether the declared type is wrong, carved objects)."""
    found = objects(value, automaton)
    whole = found[0] if found and found[0][0] == 0 else None
    kind = whole[2] if whole else "application/octet-stream"
    return kind, whole[1] if whole else len(value), declared is not None and declared != kind, found[1:] if whole else found


def sniff(df: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """Adds media_type (corrected), media_length, declared_wrong and carved (array of start, length, type) to df."""
    df = without(df, *{"media_type", "media_length", "declared_wrong", "carved"} - {content, declared})
    schema = "media_type string, media_length long, declared_wrong boolean, carved array<struct<start:long,length:long,type:string>>"
    places = [df.columns.index(c) for c in (content, declared or content)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signature_automaton()
        for batch in batches:
            kinds, lengths, wrong, carved = [], [], [], []
            said = batch.column(places[1]).to_pylist() if declared else [None] * batch.num_rows
            for value, given in zip(batch.column(places[0]), said, strict=True):
                kind, length, differs, inner = sniffed(value.as_py() or b"", given, automaton)
                kinds.append(kind)
                lengths.append(length)
                wrong.append(differs)
                carved.append([{"start": s, "length": n, "type": k} for s, n, k in inner])
            extra = [pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(carved, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "media_type", "media_length", "declared_wrong", "carved"])

    return mapped(df, run, schema)


def pad(payload: bytes) -> bytes:
    """payload and bytes 255 up to a positive multiple of 576."""
    return payload + b"\xff" * (BLOCK - len(payload) if not payload else -len(payload) % BLOCK)


def text_as_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as a WAV of 8-bit samples, sniffs and validates the stored bytes, reads the samples back, and describes them.

    Null text is empty. One row per input row: key, sizes, digests, media_type, n_carved and feature (samples, mean and
    deviation in hundredths, extremes, zero crossings around 128, carved objects).
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_carved long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signature_automaton()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode()
                stored = wav_of(pad(raw))
                kind, length, wrong, _ = sniffed(stored, "audio/wav", automaton)
                if wrong or length != len(stored):
                    raise ValueError("a stored value does not validate as WAV")
                back = wav_samples(stored)
                inner = objects(back, automaton)
                x = np.frombuffer(back, np.uint8)
                mean = int(x.sum(dtype=np.int64)) / len(x)
                crossings = int(np.count_nonzero(np.diff(x >= 128)))
                feature = f"wav:{RATE}:{len(x)}:{mean:.2f}:{float(x.std()):.2f}:{x.min()}:{x.max()}:{crossings}:{len(inner)}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, kind, len(inner)))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "n_carved"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=[key, *names])

    return df.select(key, text).mapInArrow(run, schema)
