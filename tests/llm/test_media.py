import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

import pytest

from agentframe.llm import media


def _png() -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "BM RIFF PK", "same", "same", "y" * 100_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    rows = {r.doc_id: r for r in media.text_as_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * ((-len(raw) % 576) if raw else 576)
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(want))
        assert rows[i].payload_sha256 == hashlib.sha256(want).hexdigest() and rows[i].tail_crc32 == zlib.crc32(want[-32:])
        stored = media.wav_of(want)
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[6].feature == rows[7].feature
    assert media.text_as_media(df.limit(0)).collect() == []


def test_sniffing_corrects_and_carves(spark):
    png, wav = _png(), media.wav_of(b"\x80" * 576)
    values = [(0, png, "image/gif"), (1, b"junk" + png + b"BMxx" + wav, None), (2, wav[:-1], "audio/wav"), (3, None, None), (4, b"", "image/png")]
    df = spark.createDataFrame(values, "id int, body binary, type string")
    got = {r.id: r for r in media.sniff(df, "body", "type").collect()}
    assert got[0].media_type == "image/png" and got[0].declared_wrong and got[0].carved == []
    assert [(c.start, c.length, c.type) for c in got[1].carved] == [(4, len(png), "image/png"), (8 + len(png), len(wav), "audio/wav")]
    assert got[2].media_type == "application/octet-stream" and got[2].declared_wrong
    assert got[3].media_length == 0 and got[4].declared_wrong


def _wave(code, channels, bits, data, extra=b""):
    block = channels * bits // 8
    form = struct.pack("<HHIIHH", code, channels, 44100, 44100 * block, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_any_well_formed_wave_is_audio(spark):
    good = [_wave(1, 2, 16, b"\1\2" * 64), _wave(3, 1, 32, b"\0" * 64), _wave(0xFFFE, 6, 24, b"\0" * 36, b"\x16\0" + b"\0" * 22)]
    bad = [good[0][:-1], good[0].replace(b"fmt ", b"fmtx"), good[0].replace(b"data", b"datx"), good[0].replace(struct.pack("<I", 128), struct.pack("<I", 999))]
    df = spark.createDataFrame([(i, v, "audio/wav") for i, v in enumerate([*good, *bad, b"junk" + good[0] + b"end"])], "id int, body binary, type string")
    got = {r.id: r for r in media.sniff(df, "body", "type").collect()}
    for i, v in enumerate(good):
        assert (got[i].media_type, got[i].media_length, got[i].declared_wrong, got[i].carved) == ("audio/wav", len(v), False, [])
        assert media.wav_samples(v) is None
    assert all(got[i].media_type == "application/octet-stream" and got[i].declared_wrong for i in (3, 4, 5, 6))
    assert [tuple(c) for c in got[7].carved] == [(4, len(good[0]), "audio/wav")]


def test_stored_type_is_the_sniffed_one(spark, monkeypatch):
    monkeypatch.setitem(media.VALIDATORS, "audio/wav", lambda b, at: None)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert media.sniffed(media.wav_of(b"ab"), "audio/wav", media.signature_automaton()) == ("application/octet-stream", 46, True, [])
    monkeypatch.undo()
    assert [r.media_type for r in media.text_as_media(df).collect()] == ["audio/wav"]


def _zip_bytes(comment=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "first PK\3\4 inside")
        z.writestr("b.txt", "second")
        z.comment = comment
    return held.getvalue()


def test_other_formats_end_where_their_structure_ends():
    automaton = media.signature_automaton()
    first = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n30\n%%EOF"
    pdf = first.replace(b"30\n%%EOF", b"%d\n%%%%EOF" % first.index(b"xref\n0"))
    revised = pdf + b"\n2 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % (len(pdf) + 21)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3xcoded\xff\0more\xff\xd3\xff\xd9"
    webp = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8L" + struct.pack("<I", 4) + b"abcd"
    page = lambda flags, data: b"OggS\0" + bytes([flags]) + b"\0" * 8 + b"strm" + b"\0" * 8 + bytes([1, len(data)]) + data
    ogg = page(2, b"head") + page(0, b"middle") + page(4, b"end")
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cmoovabcd" + b"\0\0\0\x09mdatx"
    cases = [(revised, "application/pdf"), (_zip_bytes(), "application/zip"), (_zip_bytes(b"a comment"), "application/zip"), (jpeg, "image/jpeg"), (webp, "image/webp"), (ogg, "application/ogg"), (mp4, "video/mp4")]
    for value, kind in cases:
        assert media.sniffed(value, kind, automaton) == (kind, len(value), False, [])
        assert media.objects(b"junk" + value + b"tail", automaton) == [(4, len(value), kind)]
        assert media.objects(value[: len(value) // 2], automaton) == []
    assert media.objects(b"".join(v for v, _ in cases), automaton) == [(sum(len(v) for v, _ in cases[:i]), len(cases[i][0]), cases[i][1]) for i in range(len(cases))]
    assert media.objects(jpeg.replace(b"\xff\xd9", b"\xff\0"), automaton) == [] and media.objects(pdf.replace(b"xref\n0", b"xxxx\n0"), automaton) == []


def test_signature_hits_match_plain_search():
    rng = random.Random(3)
    parts = [m for m, _, _ in media.MAGIC] + [b"RIF", b"Ogg", b"xx", b"\0", b"%PD"]
    value = b"".join(rng.choice(parts) for _ in range(4000))
    got = sorted((last + 1 - size, size) for last, (size, _, _) in media.signature_automaton().iter(value.decode("latin-1")))
    assert got == sorted((i, len(m)) for m, _, _ in media.MAGIC for i in range(len(value)) if value.startswith(m, i))


def test_time_grows_with_length():
    automaton = media.signature_automaton()
    seconds = []
    for n in (100_000, 400_000):
        began = time.process_time()
        assert media.objects(b"%PDF-x PK\3\4 startxref " * (n // 22), automaton) == []
        seconds.append(time.process_time() - began)
    assert seconds[1] < 12 * seconds[0] + 1


def test_features_match_plain_numbers(spark):
    texts = ["abc", "é" * 300, ""]
    rows = {r.doc_id: r for r in media.text_as_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        x = list(t.encode()) + [255] * ((-len(t.encode()) % 576) if t else 576)
        mean = sum(x) / len(x)
        deviation = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:], strict=False))
        assert rows[i].feature == f"wav:8000:{len(x)}:{mean:.2f}:{deviation:.2f}:{min(x)}:{max(x)}:{crossings}:0"


def test_clashing_columns_give_way(spark):
    df = spark.createDataFrame([(1, _png(), "mine", 5)], "id int, body binary, Media_Type string, carved int")
    row = media.sniff(df, "body").collect()[0]
    assert row.asDict().keys() == {"id", "body", "media_type", "media_length", "declared_wrong", "carved"} and row.media_type == "image/png"


def _pages(n):
    return b"".join(b"OggS\0\2" + b"\0" * 8 + b"same" + b"\0" * 8 + b"\2\1\1" + b"xx" for _ in range(n))


@pytest.mark.parametrize(
    "many",
    [lambda n: b"\0\0\0\x08ftyp" * n, _pages, lambda n: b"\x89PNG\r\n\x1a\n" * n, lambda n: (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 36 * n) + b"IDAT") * n, lambda n: b"GIF89a" + b"\0" * 7 + b"!\xff" + b"\x02GI" * n, lambda n: b"\xff\xd8\xff\xda\0\2" * n,
     lambda n: (b"RIFF" + struct.pack("<I", 9 * n) + b"WAVEjunk\0\0\0\0") * n, lambda n: b"\0\0\0\x10ftyp\0\0\0\x08free" * n],
)
def test_time_grows_with_the_length(many):
    automaton = media.signature_automaton()

    def seconds(n):
        began = time.process_time()
        media.objects(many(n), automaton)
        return time.process_time() - began

    seconds(500)
    one, four = min(seconds(2000) for _ in range(2)), seconds(8000)
    assert four < 8 * one + 0.15


def test_sums_of_ranges():
    value = media.Value(bytes(i * i % 251 for i in range(50_000)))
    for a, b in ((0, 50_000), (1, 49_999), (4096, 40_960), (5, 9000), (0, 8192), (100, 100), (8191, 49_152)):
        assert value.crc(a, b) == zlib.crc32(value[a:b])


def test_walks_from_any_place_agree():
    """What one walk learnt does not change another: each object alone and all of them after each other."""
    gif = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xx\xff\0yy\xff\xd9"
    box = b"\0\0\0\x10ftypisom0000\0\0\0\x08moov"
    ogg = b"OggS\0\2" + b"\0" * 8 + b"same" + b"\0" * 8 + b"\1\2xx" + b"OggS\0\4" + b"\0" * 8 + b"same" + b"\0" * 8 + b"\1\2xx"
    parts = [_png(), gif, jpeg, media.wav_of(b"\x80" * 20), ogg, box]
    whole = b"..".join(p for p in parts)
    found = media.objects(whole, media.signature_automaton())
    assert [n for _, n, _ in found] == [len(p) for p in parts]
    at = 0
    for (start, _, _), part in zip(found, parts, strict=True):
        assert start == at
        at += len(part) + 2
