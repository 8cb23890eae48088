"""Line dedup: sharded cuckoo filters over an exact reference-count table of line keys; insertions and deletions can be undone.

The key of a line is the line with ASCII white space stripped and A-Z lower-cased, held as a 128-bit hash. The reference-count table
has for each non-empty key the number of documents with it; adding documents adds to it, deleting them subtracts. Keys
with at least ``limit`` documents go into one cuckoo filter per shard (32-bit fingerprints, two buckets of four), which lose and gain keys as
counts cross the limit. A line is dropped when its key is in the filter and not among the false positives, which are found exactly by
probing with every key of the table that is under the limit. Filters are broadcast up to ``WAVE_KEYS`` keys; with more keys, the lines of each
different text are joined with the table by key instead and folded back by text, in one pass, so memory is bounded at every size.

Null or empty text is one empty line, which is never dropped. When all lines go, the empty text stays. Repeated rows count as documents. A count at the limit
drops the line. Texts of any length are split whole. An empty table gives no rows. Input columns with the name of an added one give way to it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import SPACES, discard, mapped, materialise, mix64, tidy, without

#: Documents of a dropped line at least; keys of a filter, and of all filters that are broadcast, at most; slots of a bucket; keys that a task counts before it sends them on.
LIMIT, SHARD_KEYS, WAVE_KEYS, BUCKET, FLUSH = 10, 1 << 16, 1 << 22, 4, 200_000


def key_digests(lines: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of each line's key hash; zeros for an empty key."""
    none = bytes(16)
    keys = (x.strip(SPACES).lower() for x in lines)
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) if k else none for k in keys), "<u8").reshape(-1, 2)


class CuckooFilter:
    """Fingerprints of 32 bits in 2 ** bits buckets of four; insert and delete are exact inverses."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys) / (0.85 * BUCKET) + 1)))), BUCKET), np.uint32))

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        print_ = (digests[:, 1] & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        first = mix64(digests[:, 0]) & mask
        return print_.astype(np.uint32), first.astype(np.int64), ((first ^ mix64(print_)) & mask).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(digests)
        return (self.slots[a] == fp[:, None]).any(1) | (self.slots[b] == fp[:, None]).any(1)

    def insert(self, digests: np.ndarray) -> bool:
        """False, with the filter as it was, if a key finds no place; the filter is then to be built anew, larger."""
        mask, rng, before = len(self.slots) - 1, np.random.default_rng(7), self.slots.copy()
        for fp, a, b in zip(*(x.tolist() for x in self.places(digests)), strict=True):
            at = a if (self.slots[a] == 0).any() else b
            for _ in range(500):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = fp
                    break
                k = int(rng.integers(BUCKET))
                fp, self.slots[at, k] = int(self.slots[at, k]), fp
                at ^= int(mix64(np.array([fp], np.uint64))[0]) & mask
            else:
                self.slots = before
                return False
        return True

    def delete(self, digests: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(digests)), strict=True):
            for at in (a, b):
                if len(k := np.flatnonzero(self.slots[at] == fp)):
                    self.slots[at, k[0]] = 0
                    break

    @classmethod
    def of(cls, digests: np.ndarray) -> CuckooFilter:
        size = len(digests)
        while not (found := cls.sized(size)).insert(digests):
            size = 2 * size + 8
        return found

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint32).reshape(-1, BUCKET))


def count_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, refs): documents with each non-empty key, counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["h1", "h2", "refs"])
            held.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py()
                if raw:
                    keys = {x.strip(SPACES).lower() for x in raw.encode().split(b"\n")}
                    keys.discard(b"")
                    held.update(map(xxhash.xxh3_128_digest, keys))
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return df.select(text).mapInArrow(tidy(run), "h1 long, h2 long, refs long").groupBy("h1", "h2").agg(F.sum("refs").alias("refs"))


@dataclass(frozen=True)
class LineIndex:
    """The exact reference counts of the documents added and not deleted."""

    refs: DataFrame
    limit: int = LIMIT

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text", limit: int = LIMIT) -> LineIndex:
        return cls(materialise(count_lines(docs, text), "line-refs"), limit)

    def _with(self, docs: DataFrame, sign: int, text: str) -> LineIndex:
        delta = count_lines(docs, text).withColumn("refs", F.lit(sign) * F.col("refs"))
        refs = self.refs.unionByName(delta).groupBy("h1", "h2").agg(F.sum("refs").alias("refs")).where("refs > 0")
        return LineIndex(materialise(refs, "line-refs"), self.limit)

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._with(docs, 1, text)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._with(docs, -1, text)

    def frequent(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.limit)

    def filters(self, shards: int) -> DataFrame:
        """(shard, filter): one cuckoo filter over the frequent keys of each shard."""

        def build(table: pa.Table) -> pa.Table:
            digests = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], 1)
            return pa.table({"shard": table.column("shard")[:1], "filter": pa.array([CuckooFilter.of(digests).tobytes()], pa.binary())})

        return self.frequent().withColumn("shard", F.pmod("h2", F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, filter binary")


def shift_filters(filters: DataFrame, before: LineIndex, after: LineIndex, shards: int) -> DataFrame:
    """The filters of before brought to after by insertions and deletions of the keys that crossed the limit, shard by shard. A shard that is full grows: it is built anew from its keys."""
    was, now = before.frequent().select("h1", "h2", F.lit(True).alias("was")), after.frequent().select("h1", "h2", F.lit(True).alias("now"))
    changes = was.join(now, ["h1", "h2"], "full").withColumn("shard", F.pmod("h2", F.lit(shards)))

    def run(old: pa.Table, moved: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else moved).column("shard")[:1]
        found = CuckooFilter(CuckooFilter.frombytes(old.column("filter")[0].as_py()).slots.copy()) if old.num_rows else CuckooFilter.sized(SHARD_KEYS)
        digests = np.stack([moved.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], 1)
        was, now = (np.array(moved.column(c).is_valid()) for c in ("was", "now"))
        found.delete(digests[was & ~now])
        if not found.insert(digests[now & ~was]):
            found = CuckooFilter.of(digests[now])
        return pa.table({"shard": shard, "filter": pa.array([found.tobytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(run, "shard long, filter binary")


def _probe(filters: dict[int, CuckooFilter], shards: int, digests: np.ndarray) -> np.ndarray:
    shard = (digests[:, 1].view(np.int64) % shards).astype(np.int64)
    hit = np.zeros(len(digests), bool)
    for k, found in filters.items():
        at = np.flatnonzero(shard == k)
        if len(at):
            hit[at] = found.contains(digests[at])
    return hit & (digests != 0).any(1)


def drop_lines(docs: DataFrame, index: LineIndex, text: str = "text") -> DataFrame:
    """docs with kept_text in place of text, n_lines and n_dropped; every other column of docs stays."""
    spark = docs.sparkSession
    docs = without(docs, *{"kept_text", "n_lines", "n_dropped"} - {text}).withColumnRenamed(text, "kept_text")
    keys = index.frequent().count()
    if keys > WAVE_KEYS:
        return _dropped_by_join(docs, index)
    shards = max(1, -(-keys // SHARD_KEYS))
    built = materialise(index.filters(shards), "line-filters")
    held = spark.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in built.collect()})
    discard(built)

    def false_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.frombytes(v) for k, v in held.value.items()}
        for batch in batches:
            digests = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)], 1)
            yield batch.filter(pa.array(_probe(filters, shards, digests)))

    wrong = index.refs.where(F.col("refs") < index.limit).select("h1", "h2").mapInArrow(false_hits, "h1 long, h2 long")
    exceptions = {np.array([r.h1, r.h2], "<i8").tobytes() for r in wrong.toLocalIterator()}

    def hits() -> Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]:
        filters = {k: CuckooFilter.frombytes(v) for k, v in held.value.items()}

        def of(digests: np.ndarray, owner: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            hit = _probe(filters, shards, digests)
            if exceptions:
                for k in np.flatnonzero(hit):
                    hit[k] = digests[k].tobytes() not in exceptions
            return hit

        return of

    return _dropped(docs, hits)


def _dropped_by_join(docs: DataFrame, index: LineIndex) -> DataFrame:
    """drop_lines with the table of counts itself: the lines of each different text meet the frequent keys in a join, whose crowded keys adaptive execution splits."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, digests = [], [np.zeros((0, 2), np.uint64)]
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(key_digests((value.as_py() or "").encode().split(b"\n")), axis=0)
                names += [name] * len(own)
                digests.append(own)
            both = np.concatenate(digests).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["__name", "h1", "h2"])

    named = docs.withColumn("__name", F.md5(F.coalesce("kept_text", F.lit(""))))
    said = named.select("__name", "kept_text").mapInArrow(tidy(lines), "__name string, h1 long, h2 long")
    gone = said.join(index.frequent().select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("__name").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))

    both = named.join(gone, "__name", "left")
    place = both.columns.index("__gone")

    def hits() -> Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]:
        def of(digests: np.ndarray, owner: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            sets = [{(k["h1"], k["h2"]) for k in own or ()} for own in part.column(place).to_pylist()]
            pairs = map(tuple, digests.view(np.int64).tolist())
            return np.array([pair in sets[k] for pair, k in zip(pairs, owner.tolist(), strict=True)], bool)

        return of

    return _dropped(both, hits).drop("__name", "__gone")


def _dropped(docs: DataFrame, hits: Callable[[], Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """docs (.., kept_text) without the lines that hits tells by their digests, with n_lines and n_dropped."""
    place = docs.columns.index("kept_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = hits()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                split = [(v.as_py() or "").encode().split(b"\n") for v in part.column(place)]
                size = np.array([len(lines) for lines in split], np.int64)
                hit = of(key_digests([x for lines in split for x in lines]), np.repeat(np.arange(len(split)), size), part)
                kept, dropped, at = [], [], 0
                for lines in split:
                    gone = hit[at : at + len(lines)]
                    at += len(lines)
                    dropped.append(int(gone.sum()))
                    kept.append((b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g) if dropped[-1] else b"\n".join(lines)).decode())
                columns = list(part.columns)
                columns[place] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size), pa.array(dropped, pa.int64())], names=[*part.schema.names, "n_lines", "n_dropped"])

    return mapped(docs, tidy(run), "n_lines long, n_dropped long")


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_lines, n_dropped and kept_sha256 for each row."""
    docs = df.select(F.col(key), F.col(text).alias("__text"))
    out = drop_lines(docs, LineIndex.of(docs, "__text", limit), "__text")
    return out.select(key, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, x, i, translate(regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {LIMIT}),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
