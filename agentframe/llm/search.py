"""Ranked lexical search: an inverted index in shards, searched with MaxScore.

A shard holds the postings of about ``SHARD_BYTES`` of whole texts as one row of arrays: its documents in the order of their keys with their lengths, its terms (64-bit
hashes, sorted), and per term the documents, the frequencies and the impact skyline, that is the (frequency, length) pairs that no other posting of the term dominates. The
index is written once; searching it shuffles nothing but the best few rows of each task.

MaxScore: a term's upper bound in a shard is exact, the best score on its skyline. While a query's k-th best score is ``t``, the terms whose bounds sum to less than
``t`` are non-essential. Documents come in blocks: the essential lists' postings are added up, and the non-essential lists are probed, highest bound first, for those documents
only that can still reach ``t``. Best scores carry over from shard to shard of a task. Bounds that equal ``t`` count as reaching it, so ties are settled by key.

Scores are 64-bit integers throughout. Queries go to the tasks in waves of ``WAVE_BYTES`` of text at most (and one query at least), so what is broadcast is bounded whatever
their number. Null texts have no terms; documents without terms are in no statistic. Queries without terms, or whose terms no document has, give no rows. Rows that repeat are
found each for itself; of equal scores and keys any comes first; null keys come last. Each row of the queries is searched, also where names repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from agentframe.llm.common import discard, long_rows, materialise, quoted, slices, text_buffers, tidy
from agentframe.llm.terms import lowered, term_hashes, term_spans

K, LENGTH_SHARE, SATURATION = 20, 25, 12
SHARD_BYTES, WAVE_BYTES, BLOCK_DOCS = 12 << 20, 8 << 20, 1024
_ONE = 1_000_000_000


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) once for each term of a text, and the texts' numbers of terms."""
    data = lowered(data)
    starts, ends, first = term_spans(data, offsets)
    terms, at = np.unique(term_hashes(data, starts, ends), return_inverse=True)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    width = max(1, len(terms))
    cells, tf = np.unique(owner * width + at, return_counts=True)
    return cells // width, terms[cells % width], tf, np.diff(first)


def skyline(rank: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings that no posting of the same term dominates (higher frequency, shorter text); rank numbers the terms."""
    order = np.lexsort((length, -tf, rank))
    level = length[order] - rank[order] * (1 << 40)
    least = np.minimum.accumulate(level)
    keep = np.ones(len(order), bool)
    keep[1:] = level[1:] < least[:-1]
    return order[keep]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, one row a shard and one shard a row group, so that no task holds more than one at once. Keys may be of any type whose values compare."""
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    fields = {"lengths": longs, "terms": longs, "starts": longs, "docs": ints, "tfs": ints, "sky_starts": longs, "sky_tf": longs, "sky_length": longs, "n_docs": LongType(), "n_terms": LongType()}
    schema = StructType([StructField("keys", ArrayType(docs.schema[key].dataType)), *(StructField(k, v) for k, v in fields.items())])

    def shard(held: list[tuple]) -> pa.RecordBatch:
        keys = [k for part in held for k in part[0]]
        lengths = np.concatenate([part[4] for part in held])
        bases = np.cumsum([0, *(len(part[0]) for part in held)])
        doc = np.concatenate([part[1] + base for part, base in zip(held, bases, strict=False)])
        terms, rank = np.unique(np.concatenate([part[2] for part in held]), return_inverse=True)
        tf = np.concatenate([part[3] for part in held])
        placed = np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0)), np.int64)
        number = np.empty(len(keys), np.int64)
        number[placed] = np.arange(len(keys))
        order = np.argsort(rank * len(keys) + number[doc])
        doc, rank, tf, lengths = number[doc[order]], rank[order], tf[order], lengths[placed]
        sky = skyline(rank, tf, lengths[doc])
        edges = np.arange(len(terms) + 1)
        arrays = [pa.array([keys[i] for i in placed], held[0][5]), lengths, terms, np.searchsorted(rank, edges), doc.astype(np.int32), tf.astype(np.int32), np.searchsorted(rank[sky], edges), tf[sky], lengths[doc[sky]]]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in arrays]
        return pa.RecordBatch.from_arrays([*lists, pa.array([len(keys)], pa.int64()), pa.array([lengths.sum()], pa.int64())], names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                doc, term, tf, lengths = _counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = np.flatnonzero(lengths)
                number = np.cumsum(lengths > 0) - 1
                if len(some):
                    keys = batch.column(0).slice(a, b - a).take(pa.array(some))
                    held.append((keys.to_pylist(), number[doc], term, tf, lengths[some], keys.type))
                    size += int(offsets[b] - offsets[a])
                if size >= shard_bytes:
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)

    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).mapInArrow(tidy(run), schema)
    return materialise(rows, "search-index", **long_rows(1))


@dataclass(frozen=True)
class Query:
    """A query's distinct terms and how often it has each."""

    name: object
    terms: np.ndarray
    times: np.ndarray


def read_queries(texts: DataFrame, name: str, text: str) -> list[Query]:
    """The queries of one wave, which the caller bounds."""
    rows = sorted(texts.select(F.col(quoted(name)).alias("name"), F.col(quoted(text)).alias("text")).collect(), key=lambda r: (r.name is None, str(r.name), r["text"] or ""))
    out = []
    for r in rows:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        _, terms, times, _ = _counted(data, np.array([0, len(data)]))
        out.append(Query(r.name, terms, times))
    return out


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and the document frequencies of the queries' terms (sorted hashes)."""

    n_docs: int
    n_terms: int
    terms: np.ndarray
    dfs: np.ndarray

    def weights(self) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.n_docs + 2) / (2 * self.dfs + 1))).astype(np.int64)

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * self.n_docs // self.n_terms


def _values(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def statistics(index: DataFrame, queries: list[Query]) -> Statistics:
    """One pass over the shards' lengths and dictionaries; a task sends a row a query term at most."""
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *(q.terms for q in queries)]))
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    held = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own, starts = _values(batch, row, "terms"), _values(batch, row, "starts")
                at = np.minimum(np.searchsorted(own, held.value), len(own) - 1)
                found += np.where(own[at] == held.value, starts[at + 1] - starts[at], 0)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["term", "df"])

    dfs = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        dfs[r.term] = r.df
    return Statistics(total[0] or 0, total[1] or 0, terms, dfs)


class Shard:
    """One row of the index with the query terms that it holds."""

    def __init__(self, batch: pa.RecordBatch, row: int, stats: Statistics):
        self.keys, self.tfs, self.docs = batch.column("keys")[row].values, _values(batch, row, "tfs"), _values(batch, row, "docs")
        self.starts, own = _values(batch, row, "starts"), _values(batch, row, "terms")
        self.m = stats.norms(_values(batch, row, "lengths"))
        at = np.minimum(np.searchsorted(own, stats.terms), len(own) - 1)
        self.at = np.where(own[at] == stats.terms, at, -1)
        self.weight = stats.weights()
        tf, length, cuts = (_values(batch, row, c) for c in ("sky_tf", "sky_length", "sky_starts"))
        best = np.maximum.reduceat(self.part(tf, stats.norms(length)), cuts[:-1])
        self.bound = np.where(self.at >= 0, self.weight * best[self.at], 0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.edges = np.append(np.arange(0, len(self.keys), BLOCK_DOCS), len(self.keys))
        self.probed = self.added = 0

    @staticmethod
    def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return _ONE * tf // (1000 * tf + SATURATION * m)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, frequencies and the bounds of the blocks."""
        if term not in self.lists:
            a, b = self.starts[self.at[term]], self.starts[self.at[term] + 1]
            self.lists[term] = (self.docs[a:b], self.tfs[a:b], np.searchsorted(self.docs[a:b], self.edges))
        return self.lists[term]

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        """best, the (-score, key is null, key) of the k best so far, with the documents of this shard."""
        here = self.bound[terms] > 0
        terms, times = terms[here], times[here]
        order = np.argsort(self.bound[terms] * times, kind="stable")
        terms, times = terms[order], times[order]
        below = np.cumsum(self.bound[terms] * times)
        for block in range(len(self.edges) - 1):
            least = max(1, -best[-1][0] if len(best) == k else 1)
            split = int(np.searchsorted(below, least, "left"))
            if split == len(terms):
                break
            base = self.edges[block]
            score = np.zeros(self.edges[block + 1] - base, np.int64)
            for t, n in zip(terms[split:], times[split:], strict=True):
                docs, tfs, cuts = self.postings(t)
                a, b = cuts[block], cuts[block + 1]
                if a < b:
                    score[docs[a:b] - base] += n * self.weight[t] * self.part(tfs[a:b], self.m[docs[a:b]])
                    self.added += int(b - a)
            rest = int(below[split - 1]) if split else 0
            found = np.flatnonzero((score > 0) & (score + rest >= least))
            for i in range(split - 1, -1, -1):
                if not len(found):
                    break
                docs, tfs, cuts = self.postings(terms[i])
                docs, tfs = docs[cuts[block] : cuts[block + 1]], tfs[cuts[block] : cuts[block + 1]]
                if len(docs):
                    at = np.minimum(np.searchsorted(docs, found + base), len(docs) - 1)
                    hit = docs[at] == found + base
                    self.probed += len(found)
                    score[found[hit]] += times[i] * self.weight[terms[i]] * self.part(tfs[at[hit]], self.m[docs[at[hit]]])
                rest = int(below[i - 1]) if i else 0
                found = found[score[found] + rest >= least]
            if len(found):
                top = found[np.lexsort((found, -score[found]))[:k]]
                keys = self.keys.take(pa.array(top + base)).to_pylist()
                best = sorted([*best, *((-int(s), key is None, key) for s, key in zip(score[top], keys, strict=True))], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
        return best


def search(index: DataFrame, queries: list[Query], stats: Statistics, k: int = K) -> DataFrame:
    """(query, score, key): the k best of each task, of which the k best of all are a part; query numbers the list."""
    kind = index.schema["keys"].dataType.elementType
    held = index.sparkSession.sparkContext.broadcast(([(np.searchsorted(stats.terms, q.terms), q.times) for q in queries], stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = held.value
        best: list[list[tuple]] = [[] for _ in asked]
        form = None
        for batch in batches:
            form = batch.schema.field("keys").type.value_type
            for row in range(batch.num_rows):
                shard = Shard(batch, row, known)
                for q, (terms, times) in enumerate(asked):
                    best[q] = shard.search(terms, times, k, best[q])
        if form is not None:
            rows = [(q, -s, key) for q, found in enumerate(best) for s, _, key in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), form))], names=["query", "score", "key"])

    schema = StructType([StructField("query", LongType()), StructField("score", LongType()), StructField("key", kind)])
    return index.drop("n_docs", "n_terms").mapInArrow(tidy(run), schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with rank. The rows of a query are cut in groups by key first, so no task gets all that the tasks found."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    part = Window.partitionBy("query", "part").orderBy(*order)
    first = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return first.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def waves(queries: DataFrame, name: str, text: str, limit: int = WAVE_BYTES) -> list[DataFrame]:
    """The queries in groups of about limit bytes, by a hash of their names and texts."""
    size = queries.agg(F.sum(F.octet_length(F.col(quoted(text))) + 100)).first()[0] or 0
    n = -(-2 * size // limit) if size > limit else 1
    group = F.pmod(F.xxhash64(F.col(quoted(name)).cast("string"), F.col(quoted(text))), F.lit(n))
    return [queries.where(group == i) for i in range(n)] if n > 1 else [queries]


def ranked_search(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", name: str = "item_id", query_text: str = "text", k: int = K, wave_bytes: int = WAVE_BYTES
) -> DataFrame:
    """(name, rank, key, score): the k best documents of each query."""
    index = build_index(docs, key, text)
    schema = StructType([StructField("query", LongType()), StructField(name, queries.schema[name].dataType)])
    out = None
    for wave in waves(queries, name, query_text, wave_bytes):
        asked = read_queries(wave, name, query_text)
        found = materialise(search(index, asked, statistics(index, asked), k), "search-found")
        named = docs.sparkSession.createDataFrame([(i, q.name) for i, q in enumerate(asked)], schema)
        rows = best_of(found, k).join(F.broadcast(named), "query").select(F.col(quoted(name)), F.col("rank").cast("int"), F.col("key").alias(key), "score")
        out = rows if out is None else out.unionByName(rows)
    discard(index)
    return out


SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, total GROUP BY term, docs),
norms AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // l AS m FROM lengths, total),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL) JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id)
  GROUP BY item_id, doc_id
),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
