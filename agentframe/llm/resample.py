"""Target-distribution importance resampling: documents drawn as if from the distribution of a target collection.

Every text's features (runs of 1 to ``LONGEST`` consecutive terms) are hashed into ``BUCKETS`` by CRC-32. The sparse document-by-bucket count matrix is written once
as CSR blocks, one row of arrays a slice of texts, four rows a row group, so that no task holds more at once. Column sums of the corpus' and of the target's blocks give the two smoothed distributions,
a bucket's gain is the scaled logarithm of their ratio, and the product of the matrix with the gains gives each document's weight. A Gumbel variable that depends on the
document's key alone is added, and the highest scores are drawn: sampling without replacement, the same in every run.

Ranks come from one range-partitioned sort of narrow rows and the offsets of its partitions, so no task holds more than its range.
Only the gains (one number a bucket) are broadcast. Null text has no features. A null key hashes as an empty one and sorts last; rows that are equal in score and key
get different ranks in any order. Rows of one key count and are ranked each for itself. Without a target all gains follow the corpus alone; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from agentframe.llm.common import discard, long_rows, materialise, quoted, slices, text_buffers, tidy
from agentframe.llm.terms import lowered, run_crcs, term_spans

BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20


def csr_blocks(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The count matrix, a block a slice of texts: keys and words of its documents, and CSR arrays indptr, buckets, counts."""
    kind = docs.schema[key].dataType
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    schema = StructType([StructField("keys", ArrayType(kind)), StructField("words", longs), StructField("indptr", longs), StructField("buckets", ints), StructField("counts", ints)])

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                part, own = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                starts, ends, first = term_spans(part, own)
                crc, row = run_crcs(part, starts, ends, first, longest)
                cells, counts = np.unique(row * buckets + (crc % np.uint32(buckets)).astype(np.int64), return_counts=True)
                indptr = np.searchsorted(cells, np.arange(b - a + 1) * buckets)
                arrays = [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(indptr), pa.array((cells % buckets).astype(np.int32)), pa.array(counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([listed(x) for x in arrays], names=[f.name for f in schema.fields])

    return docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).mapInArrow(tidy(run), schema)


def _values(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. A task sends one row a bucket at most, summed before the shuffle; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                np.add.at(total, _values(batch, row, "buckets"), _values(batch, row, "counts"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = blocks.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the target's to the corpus' smoothed share of each bucket."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, words, n_features, weight) of every document: the product of the matrix with the gains."""
    kind = blocks.schema["keys"].dataType.elementType
    held = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                indptr, counts = _values(batch, row, "indptr"), _values(batch, row, "counts").astype(np.int64)
                sums = np.zeros((2, len(counts) + 1), np.int64)
                np.cumsum(counts, out=sums[0, 1:])
                np.cumsum(counts * held.value[_values(batch, row, "buckets")], out=sums[1, 1:])
                n, weight = np.diff(sums[:, indptr], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("keys")[row].values, pa.array(_values(batch, row, "words")), pa.array(n), pa.array(weight)], names=["key", "words", "n_features", "weight"])

    schema = StructType([StructField("key", kind), *(StructField(c, LongType()) for c in ("words", "n_features", "weight"))])
    return blocks.mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel variable), a pure function of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (key, words, score, ...) with rank: the place, from 1, of the drawn; null for all others."""
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("key").asc_nulls_last()]
    rows = scored.withColumn("eligible", F.col("words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = materialise(rows, "resample-sorted").withColumn("part", F.shiftright("place", 33))
    sizes = sorted((r.part, r.n, r.able) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("able")).collect())
    before, at = [], 0
    for part, n, _ in sizes:
        before.append((part, at))
        at += n
    drawn = percent * sum(able for *_, able in sizes) // 100
    spark = scored.sparkSession
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part").withColumn("rank", F.when(F.col("eligible") & (rank <= drawn), rank)).drop("part", "before", "place", "eligible")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """key, n_features, weight, score and rank for each row of docs."""
    blocks = materialise(csr_blocks(docs, key, text, buckets, longest), "resample-csr", **long_rows(4))
    wanted = csr_blocks(target.select(F.lit(0).alias("key"), F.col(quoted(target_text)).alias("text")), "key", "text", buckets, longest)
    scored = weights(blocks, gains(column_sums(blocks, buckets), column_sums(wanted, buckets))).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    out = ranked(scored, percent, least_words)
    discard(blocks)
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


SQL = r"""
WITH base AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) FROM benchmark
),
counts AS (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counts)),
bucketed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM hexed, base
),
cells AS (SELECT side, id, bucket, sum(n) AS n FROM counts JOIN bucketed USING (w) GROUP BY ALL),
sums AS (SELECT b AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM range(10000) r(b) LEFT JOIN cells ON bucket = b GROUP BY b),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM sums),
weighed AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM cells JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed ON id = doc_id
),
placed AS (SELECT doc_id, n_features, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p USING (doc_id)
"""
