import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from agentframe.llm import search


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, queries, k=20):
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, total = len(own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for name, text in queries:
        rows = []
        for i, c, n in own:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if s > 0:
                rows.append((s, i))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(name, rank + 1, i, s) for rank, (s, i) in enumerate(rows[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(80)] + ["Été", "中", "the", "THE", "a_b"]
    say = lambda n: " ".join(rng.choice(vocab[: rng.randint(2, len(vocab))]) for _ in range(n))
    rows = [(i * 7 % 1009, say(rng.randint(0, 40))) for i in range(700)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # ties over more places than there are ranks
    return [*rows, (None, rows[5][1]), (None, "the w1"), (3000, None), (3001, ""), (3002, "... !"), (3003, "the w3 " * 40000), (14, rows[2][1])]


QUERIES = [("a", "the w1 w2 The"), ("b", "w5 w6 w7 w8 w9 w10 the the 中"), ("c", None), ("d", ""), ("e", "nowhere"), ("f", "w79"), (None, "été w3 w3 w3"), ("a", "w4")]


@pytest.mark.parametrize(("shard_bytes", "block", "wave_bytes"), [(12 << 20, 1024, 8 << 20), (3000, 16, 200)])
def test_matches_brute_force(spark, monkeypatch, shard_bytes, block, wave_bytes):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    docs = [*corpus(), (4000, corpus()[5][1])]
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, `meta.url` string, score int").repartition(4)
    queries = spark.createDataFrame([(*q, 1) for q in QUERIES], "item_id string, text string, rank int")
    got = search.ranked_search(frame, queries, wave_bytes=wave_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, QUERIES)


def test_non_essential_lists_are_probed_for_few_documents():
    """A common term's list is read where a document can still qualify, not as a whole."""
    rng = random.Random(2)
    texts = ["common " + ("rare " * rng.randint(1, 4) if i % 400 == 0 else "") + " ".join(f"f{rng.randint(0, 50)}" for _ in range(20)) for i in range(20_000)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, term, tf, lengths = search._counted(data, offsets)
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    terms, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term))
    rank = np.searchsorted(terms, term)
    sky = search.skyline(rank, tf, lengths[doc])
    arrays = {"keys": np.arange(len(texts)), "lengths": lengths, "terms": terms, "starts": starts, "docs": doc.astype(np.int32), "tfs": tf.astype(np.int32), "sky_starts": np.searchsorted(rank[sky], np.arange(len(terms) + 1)), "sky_tf": tf[sky], "sky_length": lengths[doc[sky]]}
    batch = pa.RecordBatch.from_arrays([pa.array([v]) for v in arrays.values()], names=list(arrays))
    asked = np.frombuffer(b"common rare", np.uint8)
    _, wanted, times, _ = search._counted(asked, np.array([0, len(asked)]))
    dfs = np.diff(starts)[np.searchsorted(terms, wanted)]
    stats = search.Statistics(len(texts), int(lengths.sum()), wanted, dfs)
    shard = search.Shard(batch, 0, stats)
    best = shard.search(np.arange(2), times, 20, [])
    assert [(k, -s) for s, _, k in best] == [(i, s) for _, _, i, s in sorted(brute(list(enumerate(texts)), [("q", "common rare")]), key=lambda r: r[1])]
    assert shard.probed < 200 and shard.added < 5000


def test_skyline_bounds_are_exact():
    rng = np.random.default_rng(1)
    rank, tf, length = np.sort(rng.integers(0, 30, 2000)), rng.integers(1, 9, 2000), rng.integers(1, 500, 2000)
    sky = search.skyline(rank, tf, length)
    part = search.Shard.part(tf, length)
    for r in range(30):
        assert part[rank == r].max() == part[sky[rank[sky] == r]].max()
    assert len(sky) < 300


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(QUERIES, "item_id string, text string")
    assert search.ranked_search(docs, queries).collect() == []
    some = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert search.ranked_search(some, queries.where("false")).collect() == []
    assert search.ranked_search(some.withColumn("text", search.F.lit(None).cast("string")), queries).collect() == []


def test_a_row_group_of_the_index_holds_one_shard(spark):
    """Shards are rows of megabytes: a task that wrote or read a hundred of them at once ran out of memory."""
    docs = spark.createDataFrame([(i, f"word{i} other{i} third{i}") for i in range(60)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        index = search.build_index(docs, shard_bytes=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")) for f in index.inputFiles()]
    assert index.count() == 6 == sum(f.num_row_groups for f in files)
