"""Suffix-array dedup: bytes under a 400-byte string that also starts anywhere else are removed; passages of over 50 words that do so are found alike.

Windows of a fixed number of symbols (400 bytes, or 51 words with A-Z lower-cased) are dealt out by minimiser: equal windows have the same minimiser (anchor) at the same
distance. A run of windows with one anchor is a super-window. Super-windows with equal text are counted; those of one anchor with different texts
are sorted together by external recursive induction (``induction``), a shard of anchors a task. Its batches are read one by one and kept on the task's own
disk, as Spark's sorts keep theirs, so a shard may be far larger than memory; a task that is lost with its executor runs again.

An anchor with more than ``MEMBERS`` different texts is cut into blocks that meet pairwise, so no task holds an unbounded group. Null or empty text is no
byte. Rows with equal keys or texts are different places. Texts under 400 bytes lose nothing. Texts of any length are read whole, in overlapping parts. Equal windows are
all removed: there is no tie to break. An empty table gives no rows. The result has its own columns only, so columns of the input cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import BYTE_VALUES, SPACES, discard, materialise, slices, text_buffers, tidy, word_hashes, word_spans
from agentframe.llm.induction import PAD, repeated_windows
from agentframe.llm.windows import super_windows

#: Members of a shard of anchors, about, and of a block at most; tuples of a queue in memory; symbols that are cut into windows at a time, and bytes into words; ids broadcast at most.
SHARD, MEMBERS, QUEUE_ROWS, CHUNK, WORD_CHUNK, BROADCAST_ROWS = 40_000, 100_000, 1 << 18, 1 << 22, 1 << 21, 1 << 21


@dataclass(frozen=True)
class Unit:
    """What windows are made of: symbols of a window and of its minimiser."""

    name: str
    length: int
    gram: int


BYTES, WORDS = Unit("bytes", 400, 32), Unit("words", 51, 6)


def word_symbols(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of a text, read in parts that end at white space."""
    parts, at = [], 0
    while at < len(raw):
        end = at + WORD_CHUNK
        if end < len(raw):
            while end < len(raw) and raw[end] not in SPACES:
                end += 1
        part = raw[at:end]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        parts.append(word_hashes(part, starts, ends))
        at = end
    found = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return np.where(found == PAD, PAD + 1, found)


def _symbols(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit value for each symbol of the texts, the first symbol of each text)."""
    if unit.name == "bytes":
        return BYTE_VALUES[data], offsets
    if len(offsets) == 2:
        found = word_symbols(data)
        return found.view(np.uint64), np.array([0, len(found)])
    starts, ends, first = word_spans(data, offsets)
    found = word_hashes(data, starts, ends)
    return np.where(found.view(np.int64) == PAD, found + np.uint64(1), found), first


def occurrences(df: DataFrame, unit: Unit) -> DataFrame:
    """(uid, start, count, rel, anchor, digest) of the super-windows of df(uid, text)."""
    length = unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            data, places = text_buffers(batch.column(1))
            for a, b in slices(places):
                step = CHUNK if unit.name == "bytes" else max(places[b] - places[a], 1)
                for low in range(places[a], max(places[b], places[a] + 1), step):
                    high = min(places[b], low + step + (length - 1 if unit.name == "bytes" else 0))
                    values, offsets = _symbols(data[low:high], np.clip(places[a : b + 1], low, high) - low, unit)
                    skipped = np.maximum(low - places[a:b], 0)
                    for c in range(0, max(1, len(values) - length + 1), CHUNK):
                        stop = min(len(values), c + CHUNK + length - 1)
                        owner, start, *rest = super_windows(values[c:stop], np.clip(offsets, c, stop) - c, length, unit.gram)
                        start = start + skipped[owner] + np.maximum(c - offsets[:-1][owner], 0)
                        yield pa.RecordBatch.from_arrays([pa.array(uid[a + owner]), pa.array(start), *(pa.array(x) for x in rest)], names=["uid", "start", "count", "rel", "anchor", "digest"])

    return df.mapInArrow(tidy(run), "uid long, start long, count long, rel long, anchor long, digest long")


def _cut(df: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, digest, rel, body) of df(text, wanted: array of those with start and count). A body has a byte, or eight for a word, a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                for text, wanted in zip(batch.column(0).slice(a, 64), batch.column(1).slice(a, 64).to_pylist(), strict=True):
                    raw, width = text.as_py().encode(), 1
                    if unit.name == "words":
                        raw, width = word_symbols(np.frombuffer(raw, np.uint8)).tobytes(), 8
                    rows += [(w["anchor"], w["digest"], w["rel"], raw[width * w["start"] : width * (w["start"] + w["count"] + unit.length - 1)]) for w in wanted]
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["anchor", "digest", "rel", "body"])

    return df.mapInArrow(tidy(run), "anchor long, digest long, rel long, body binary")


def _own_disk() -> str | None:
    """The folder that Spark gives this executor for its own sorts."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def repeated_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """(uid, unit, a, b): starts and ends of the symbols of docs(uid, text) under repeated windows, not yet merged."""
    places = materialise(occurrences(docs, unit), "windows")
    texts = materialise(places.groupBy("anchor", "digest", "rel", "count").agg(F.count("*").alias("copies"), F.min(F.struct("uid", "start")).alias("at")), "window-texts")
    crowded = texts.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1")
    wanted = materialise(texts.join(crowded, "anchor").select(F.col("at.uid").alias("uid"), F.struct("anchor", "digest", "rel", "count", F.col("at.start").alias("start")).alias("w"), "members"), "wanted")
    per_doc = wanted.groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    n = wanted.count()
    ids = wanted.select("uid").distinct()
    holders = docs.join(F.broadcast(ids), "uid", "left_semi") if n <= BROADCAST_ROWS else docs
    bodies = _cut(holders.join(per_doc, "uid").dropDuplicates(["uid"]).select("text", "wanted"), unit)
    hot = wanted.where(F.col("members") > MEMBERS).select(F.col("w.anchor").alias("anchor"), F.expr(f"cast(ceil(members / {MEMBERS}) as int)").alias("blocks")).distinct()
    shards = max(1, -(-n // SHARD))
    dealt = bodies.join(hot, "anchor", "left") if not hot.isEmpty() else bodies.withColumn("blocks", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    meets = F.when(F.col("blocks").isNull(), F.array(F.pmod("anchor", F.lit(shards)))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("anchor", F.least(own, o), F.greatest(own, o))))
    dealt = dealt.withColumn("shard", F.explode(meets)).drop("blocks")
    limit, kind = QUEUE_ROWS, np.uint8 if unit.name == "bytes" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                data, offsets = text_buffers(batch.column("body"))
                anchor, rel, digest = (batch.column(c).to_numpy() for c in ("anchor", "rel", "digest"))
                yield anchor, rel, np.diff(offsets) // np.dtype(kind).itemsize, data.copy().view(kind), digest

        with tempfile.TemporaryDirectory(prefix="suffixes-", dir=_own_disk()) as folder:
            for found in repeated_windows(members(), unit.length, folder, limit):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["anchor", "digest", "first", "end"])

    found = dealt.groupBy("shard").applyInArrow(run, "anchor long, digest long, first long, end long")
    whole = texts.where("copies > 1").select("anchor", "digest", F.lit(0).cast("long").alias("first"), F.col("count").alias("end"))
    marks = materialise(found.unionByName(whole), "marks")
    spans = places.select("uid", "start", "anchor", "digest").join(marks, ["anchor", "digest"])
    out = materialise(spans.select("uid", F.lit(unit.name).alias("unit"), (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("end") + unit.length - 1).alias("b")), "spans")
    discard(places, texts, wanted, marks)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in runs:
        left.append(raw[at:a])
        at = b
    return b"".join([*left, raw[at:]])


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", passages: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for each row.

    With passages also n_passage_words, the words under passages of over 50 words that also stand elsewhere, and remaining_text, what neither they nor the
    removed bytes cover; where a cut parts a character, its rest is shown as U+FFFD.
    """
    docs = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("uid", F.xxhash64(F.col("key").cast("string"), "text"))
    found = repeated_spans(docs.select("uid", "text"), BYTES)
    if passages:
        found = found.unionByName(repeated_spans(docs.select("uid", "text"), WORDS))
    spans = found.groupBy("uid").agg(F.collect_set(F.struct("unit", "a", "b")).alias("spans"))
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words", "remaining_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]

    def row(value: str, spans: list[dict]) -> tuple:
        raw = value.encode()
        runs = merged([(s["a"], s["b"]) for s in spans if s["unit"] == "bytes"])
        kept = _without(raw, runs)
        said = merged([(s["a"], s["b"]) for s in spans if s["unit"] == "words"])
        more = []
        if said:
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            more = [(int(starts[a]), int(ends[b - 1])) for a, b in said]
        return len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, sum(b - a for a, b in said), _without(raw, merged(runs + more)).decode(errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = [row(value.as_py(), found or []) for value, found in zip(part.column(1), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    schema = f"key {df.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long, remaining_text string"
    out = docs.join(spans, "uid", "left").select("key", "text", "spans").mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
    return out if passages else out.drop("n_passage_words", "remaining_text")
