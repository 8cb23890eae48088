import random
import re

import corpus_pipeline
from agentframe.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(12))
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice((6, 20, 60, 200)))]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5, 9))):
                copy[rng.randrange(len(copy))] = word()
            cut = rng.choice((0, 0, len(copy) // 5))
            rows.append(" ".join(copy[cut:]) + (f"\n{shared}" if rng.random() < 0.5 else "").upper())
    rows += [None, None, "", " \t\n", "one", "one", "One", "a b c d", "a b c d", "a b c d e", "é\x0bü 日本 x y z", "w " * 4000, "w w w w w w", shared, shared]
    return [(1000 - i, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2) for r in corpus()], "doc_id long, text string, n int, node int")
    want = brute(corpus())
    assert sorted(map(tuple, jaccard.jaccard_join(df).collect())) == want
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, jaccard.jaccard_join(df.repartition(5)).collect())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(df).collect() == []


def test_null_and_shared_keys(spark):
    own = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    # 1 and 2 link only through rows without a key, whose class has no key at all.
    rows = [(1, own(0, 40)), (None, own(0, 46)), (None, own(0, 46)), (2, own(0, 54))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in jaccard.jaccard_join(df).collect()}
    assert got == {(1, 36): (1, 2), (None, 42): (1, 3), (2, 50): (1, 2)}

    rows += [(None, own(3)), (None, own(4)), (5, own(5)), (5, own(6)), (9, own(7)), (9, own(8)), (3, own(8) + " more"), (None, own(9)), (7, own(9)), (8, own(10)), (8, own(10)), (None, None), (None, None), (6, " "), (6, " ")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    want = [(1, own(0, 40)), (None, own(3)), (None, own(4)), (5, own(5)), (5, own(6)), (9, own(7)), (3, own(8) + " more"), (7, own(9)), (8, own(10)), (None, None), (None, None), (6, " "), (6, " ")]
    assert sorted(map(repr, (tuple(r)[:2] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()))) == sorted(map(repr, want))
