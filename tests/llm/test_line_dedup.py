import hashlib
from collections import Counter

import numpy as np

from agentframe.llm import line_dedup as ld


def brute(rows, limit):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    refs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if refs[key(x)] < limit]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def rows_of(n=40):
    rows = [(i, f"own {i}\n Shared LINE\t\n{'often' if i % 2 else 'OFTEN '}\n\nÉ{i % 7}") for i in range(n)]
    return [*rows, (100, None), (101, ""), (102, "shared line"), (103, "shared line"), (103, "shared line"), (104, "z\n" * 5000)]


def test_matches_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 5) for r in rows_of()], "doc_id long, text string, n_lines int")
    assert sorted(map(tuple, ld.line_dedup(df).collect())) == brute(rows_of(), 10)
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)
    monkeypatch.setattr(ld, "WAVE_KEYS", 2)
    assert sorted(map(tuple, ld.line_dedup(df, limit=5).collect())) == brute(rows_of(), 5)
    taken = df.withColumn("Kept_Text", ld.F.lit("zz")).withColumn("n_dropped", ld.F.lit("x"))
    out = ld.drop_lines(taken, ld.LineIndex.of(taken, limit=5))
    assert out.columns == ["doc_id", "kept_text", "n_lines", "n_dropped"] and sorted((r.doc_id, r.n_lines, r.n_dropped) for r in out.collect()) == sorted(x[:3] for x in brute(rows_of(), 5))
    assert ld.line_dedup(df.limit(0)).collect() == []


def test_insert_and_delete_undo_each_other(spark):
    first = spark.createDataFrame(rows_of(), "doc_id long, text string")
    more = spark.createDataFrame([(200 + i, "fresh\nshared line") for i in range(12)], "doc_id long, text string")
    start = ld.LineIndex.of(first)
    grown = start.insert(more)
    shrunk = grown.delete(more)
    assert sorted(map(tuple, shrunk.refs.collect())) == sorted(map(tuple, start.refs.collect()))
    assert grown.frequent().count() == start.frequent().count() + 1
    moved = ld.shift_filters(start.filters(1), start, grown, 1).collect()
    want = ld.CuckooFilter.frombytes(bytes(moved[0]["filter"]))
    assert want.contains(ld.key_digests([b"fresh", b" OFTEN", b"absent"])).tolist() == [True, True, False]
    back = ld.CuckooFilter.frombytes(bytes(ld.shift_filters(spark.createDataFrame(moved), grown, shrunk, 1).collect()[0]["filter"]))
    assert back.contains(ld.key_digests([b"fresh", b" OFTEN"])).tolist() == [False, True]


def test_cuckoo_filter_keeps_every_key():
    digests = ld.key_digests([str(i).encode() for i in range(3000)])
    found = ld.CuckooFilter.of(digests[:2000])
    assert found.contains(digests[:2000]).all() and found.contains(digests[2000:]).sum() == 0
    found.delete(digests[:1000])
    assert not found.contains(digests[:1000]).any() and found.contains(digests[1000:2000]).all()
    assert np.count_nonzero(found.slots) == 1000


def test_full_filters_grow_and_keep_what_they_had(spark):
    few = spark.createDataFrame([(i, "one\ntwo") for i in range(12)], "doc_id long, text string")
    many = spark.createDataFrame([(50 + i, "\n".join(f"line {k}" for k in range(400))) for i in range(12)], "doc_id long, text string")
    start = ld.LineIndex.of(few)
    grown = start.insert(many)
    moved = ld.shift_filters(start.filters(1), start, grown, 1).collect()
    found = ld.CuckooFilter.frombytes(bytes(moved[0]["filter"]))
    assert found.contains(ld.key_digests([b"one", b"two", *(f"line {k}".encode() for k in range(400))])).all()
    small = ld.CuckooFilter.of(ld.key_digests([b"a", b"b"]))
    before = small.slots.copy()
    assert not small.insert(ld.key_digests([str(i).encode() for i in range(500)])) and (small.slots == before).all()
