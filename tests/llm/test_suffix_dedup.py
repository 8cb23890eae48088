import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from agentframe.llm import induction
from agentframe.llm import suffix_dedup as sd


def brute(rows):
    seen = Counter(raw[i : i + 400] for _, raw in rows for i in range(len(raw) - 399))
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw) + 2, bool)
        for s in range(len(raw) - 399):
            if seen[raw[s : s + 400]] > 1:
                gone[s + 1 : s + 401] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[1:-1]])
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage, tail = text(900), text(450)
    rows = [None, "", "short", text(399), "x" * 1500, "ab" * 700, passage, passage, text(500) + passage + text(300), text(50) + passage[100:700] + text(100) + tail, tail + text(600) + tail, passage[:405] + "Q" + passage[406:], passage[500:] + passage[:500], "x" * 400, text(3000), "\0" * 420 + text(300) + "\0" * 410]
    near = text(1200)
    for _ in range(12):
        k = rng.randrange(len(near))
        rows.append(near[:k] + "Z" + near[k + 1 :])
    return [(i, t) for i, t in enumerate(rows)] + [(6, passage), (500, rows[-1]), (500, rows[-1])]


def test_matches_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 7, "kept") for r in corpus()], "doc_id long, text string, uid string, key int, remaining_text string")
    want = brute([(i, (t or "").encode()) for i, t in corpus()])
    assert sorted(tuple(r)[:5] for r in sd.suffix_dedup(df, passages=False).collect()) == want
    for name, value in (("MEMBERS", 3), ("CHUNK", 700), ("BROADCAST_ROWS", 0), ("SHARD", 5), ("QUEUE_ROWS", 64)):
        monkeypatch.setattr(sd, name, value)
    assert sorted(tuple(r)[:5] for r in sd.suffix_dedup(df.repartition(4), passages=False).collect()) == want
    assert sd.suffix_dedup(df.limit(0)).collect() == []


def passage_words(rows, least=51):
    """Words of each row under strings of least words that stand elsewhere too."""
    split = [(t or "").lower().split() for t in rows]
    seen = Counter(tuple(ws[i : i + least]) for ws in split for i in range(len(ws) - least + 1))
    out = []
    for ws in split:
        out.append({i + k for i in range(len(ws) - least + 1) if seen[tuple(ws[i : i + least])] > 1 for k in range(least)})
    return out


def test_passages_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    short, long, fifty = words(51), words(90), words(50)
    rows = [None, "", short, words(30) + " " + short + "\n" + words(40), words(5) + "\t" + short.upper().replace("É", "é") + " " + words(3), fifty + " " + words(9), words(9) + " " + fifty, long, words(20) + " " + long + " " + words(20), long[:200] + " x " + long[200:], words(300), "a " * 60, words(60) + " " + short + " " + words(7) + " " + long + " end"]
    want = passage_words(rows)
    assert len(want[4]) == 51 and not want[5] and not want[10]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for small in (False, True):
        if small:
            for name, value in (("MEMBERS", 2), ("CHUNK", 120), ("SHARD", 3), ("QUEUE_ROWS", 16), ("WORD_CHUNK", 50)):
                monkeypatch.setattr(sd, name, value)
        got = {r.doc_id: r for r in sd.suffix_dedup(df).collect()}
        assert [got[i].n_passage_words for i in range(len(rows))] == [len(x) for x in want]
        assert got[3].remaining_text.split() == [w for i, w in enumerate(rows[3].split()) if i not in want[3]]
        assert got[10].remaining_text == rows[10] and got[5].remaining_text == rows[5]


def test_queue_spills_and_keeps_order(tmp_path):
    rng = np.random.default_rng(3)
    queue, pushed = induction.TupleQueue(str(tmp_path), 50), []
    for _ in range(9):
        key = rng.integers(0, 6, 30)
        queue.push(key, np.arange(30), np.full(30, len(pushed)))
        pushed.append(key)
    assert queue.runs
    batches = list(queue.drain())
    rows = np.concatenate(batches, 1)
    keys = np.concatenate(pushed)
    assert max(b.shape[1] for b in batches) <= 60 and (rows[0] == np.sort(keys)).all()
    assert (rows[1] + 30 * rows[2] == np.argsort(keys, kind="stable")).all() and not list(tmp_path.iterdir())


def _shard(rng, length, kind, strings):
    """Members around anchors: pieces of a few base strings with single changes, each text once."""
    base, found = [[rng.randrange(3) for _ in range(2 * length)] for _ in range(3)], {}
    for k in range(strings):
        rel = rng.randrange(0, length - 2)
        own = rng.choice(base)[length - 2 - rel :][: rng.randint(1, rel + 1) + length - 1]
        if rng.random() < 0.4:
            own[rng.randrange(len(own))] = rng.randrange(3)
        if rel < len(own) <= rel + length:
            found[k % 4, rel, tuple(own)] = k
    rows = [(anchor - 2, rel, np.array(own, kind), k) for (anchor, rel, own), k in found.items()]
    places = {}
    for anchor, rel, own, k in rows:
        for i in range(min(len(own) - length, rel) + 1):
            places.setdefault((anchor, rel - i, tuple(own[i : i + length])), set()).add((k, i))
    return rows, {x for same in places.values() if len(same) > 1 for x in same}


def _found(rows, length, folder, limit):
    def batches():
        for a in range(0, len(rows), 4):
            part = rows[a : a + 4]
            anchor, rel, own, number = zip(*part, strict=True)
            yield np.array(anchor), np.array(rel), np.array([len(x) for x in own]), np.concatenate(own), np.array(number)

    return {(int(n), i) for _, numbers, first, end in induction.repeated_windows(batches(), length, str(folder), limit) for n, a, b in zip(numbers, first, end, strict=True) for i in range(a, b)}


@pytest.mark.parametrize(("kind", "length"), [(np.uint8, 16), (np.int64, 9)])
def test_external_induction_matches_brute_force(tmp_path, kind, length):
    rng = random.Random(5)
    for trial in range(5):
        rows, want = _shard(rng, length, kind, 30)
        for limit in (1, 7, 1 << 20):
            folder = tmp_path / f"{trial}-{limit}"
            folder.mkdir()
            assert _found(rows, length, folder, limit) == want


def test_shard_far_larger_than_memory(tmp_path):
    """Hundreds of members of up to 31 bytes with queues of 64 tuples: every queue spills, and no batch nor run in memory passes twice the limit."""
    rows, want = _shard(random.Random(8), 16, np.uint8, 1500)
    sizes, plain = [], induction.TupleQueue.drain

    def watched(self):
        for batch in plain(self):
            sizes.append(batch.shape[1])
            yield batch

    induction.TupleQueue.drain = watched
    try:
        assert len(rows) > 300 and _found(rows, 16, tmp_path, 64) == want
    finally:
        induction.TupleQueue.drain = plain
    assert max(sizes) <= 128 and sum(sizes) > 100 * 64
