import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from agentframe.llm import resample, terms

SCHEMA = "doc_id long, text string, score string, `meta.url` string, rank int"


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, longest, percent=10, least=20):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(crc(f) for _, _, fs in own for f in fs), Counter(crc(f) for x in target for f in features(x, longest)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, fs in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc(f)] for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able):
        r[4] = k + 1 if k < percent * len(able) // 100 else None
    for r in rows:
        if not any(r is a for a in able):
            r[4] = None
    return sorted(map(tuple, rows), key=str)


def corpus():
    rng = random.Random(4)
    words = ["Haus", "tree", "été", "ÀB", "x1", "中文", "a-b", "under_score", "q" * 90, "Z"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return [*rows, (900, None), (901, ""), (902, "!!! ..."), (903, "tree haus " * 30000), (None, "tree " * 25), (3, rows[3][1]), (3, "tree " * 30)]


def test_matches_brute_force(spark):
    docs, target = corpus(), ["tree été tree", None, "中文 haus x1", ""]
    frame = spark.createDataFrame([(i, t, "mine", "u", 7) for i, t in docs], SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, longest in ((10_000, 1), (97, 3)):
        got = resample.resample(frame, wanted, buckets=buckets, longest=longest)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        rows = got.collect()
        want = brute(docs, target, buckets, longest)
        assert sorted((tuple(r)[:4] for r in rows), key=str) == sorted((r[:4] for r in want), key=str)
        assert sorted((r.rank, r.doc_id) for r in rows if r.rank) == sorted((r[4], r[0]) for r in want if r[4])


def test_no_target_and_no_documents(spark):
    none = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert resample.resample(docs, none).count() == len(corpus())
    assert resample.resample(docs.where("false"), docs.select("text")).collect() == []


def test_csr_blocks_hold_all_counts(spark):
    blocks = resample.csr_blocks(spark.createDataFrame(corpus(), "doc_id long, text string"), "doc_id", "text", 50, 1).collect()
    cells = Counter()
    for b in blocks:
        assert len(b["keys"]) + 1 == len(b["indptr"]) and b["indptr"][-1] == len(b["buckets"]) == len(b["counts"])
        for k, key in enumerate(b["keys"]):
            for at in range(b["indptr"][k], b["indptr"][k + 1]):
                cells[key, b["buckets"][at]] += b["counts"][at]
    want = Counter((i, zlib.crc32(f.encode()) % 50) for i, t in corpus() for f in features(t, 1)[1])
    assert cells == want


def test_crc_of_runs_matches_zlib():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice((1, 3, 63, 64, 65, 200)))) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    sums, owner = terms.run_crcs(data, *terms.term_spans(data, offsets), 3)
    want = sorted((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in features(t, 3)[1])
    assert sorted(zip(owner.tolist(), sums.tolist(), strict=True)) == want


def test_a_row_group_of_the_matrix_holds_few_blocks(spark, monkeypatch):
    """Blocks are rows of megabytes: a task that read a row group of a hundred ran out of memory."""
    groups, write = [], resample.materialise

    def seen(df, name, **options):
        out = write(df, name, **options)
        if name == "resample-csr":
            groups.extend(pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in out.inputFiles())
        return out

    monkeypatch.setattr(resample, "materialise", seen)
    monkeypatch.setattr(resample, "slices", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(30)], "doc_id long, text string").coalesce(1)
    assert resample.resample(docs, docs.select("text")).count() == 30
    assert sum(g.num_rows for g in groups) == 30
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 4
