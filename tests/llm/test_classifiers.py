import random
import zlib

import numpy as np

from agentframe.llm import langid, toxicity


def longest_match_phrases(text: bytes, model: bytes) -> int:
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in model and text[at : at + size] in model:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_match_brute_force():
    rng = random.Random(3)
    model = "".join(rng.choice("abcd ") for _ in range(400)).encode()
    texts = ["".join(rng.choice("abcdx ") for _ in range(n)).encode() for n in (0, 1, 7, 300, 511)]
    got = langid.LanguageModel({"a": model})
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    costs = got.costs(np.frombuffer(b"".join(texts), np.uint8), offsets)[:, 0] / got.automata[0].bits
    assert np.allclose(costs, [longest_match_phrases(t, model) for t in texts])


def test_phrases_of_many_scripts_match_brute_force():
    rng = random.Random(8)
    scripts = {"ar": (0x627, 0x649), "el": (0x3B1, 0x3C9), "en": (97, 122), "hi": (0x905, 0x939), "ja": (0x3041, 0x3093), "ru": (0x430, 0x44F), "zh": (0x4E00, 0x9FA0)}
    vocab = {k: ["".join(chr(rng.randint(a, b)) for _ in range(rng.randint(1, 6))) for _ in range(60)] for k, (a, b) in scripts.items()}
    say = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n)).encode()
    samples = {k: say(k, 300) for k in scripts}
    texts = [say(k, 12) for k in scripts for _ in range(4)] + [bytes(range(128, 256))]
    assert len(set(b"".join(samples.values()))) > 100 and max(map(len, texts)) <= langid.BLOCK
    got = langid.LanguageModel(samples)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    costs = got.costs(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.allclose(costs / [a.bits for a in got.automata], [[longest_match_phrases(t, samples[k]) for k in got.names] for t in texts])
    assert [got.names[k] for k in costs[:-1].argmin(1)] == [k for k in scripts for _ in range(4)]


VOCAB = {"aa": "der und das ist nicht ein haus baum".split(), "bb": "the and of with house tree not one".split()}


def corpus():
    rng, rows = random.Random(5), []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choice(VOCAB[lang]) for _ in range(60)), lang, "s"))
    return [*rows, (900, None, "aa", None), (901, "", "bb", None), (902, "12 34 !!", "aa", None), (903, "the house and the tree " * 2000, None, None), (0, rows[0][1], "aa", "s")]


def test_language_id(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, score string")
    got = langid.language_id(df).collect()
    assert len(got) == len(corpus())
    want = {r[0]: r[2] for r in corpus()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (900, 901, 902) else "bb" if r.doc_id == 903 else want[r.doc_id])
    assert langid.language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.language_id(df.where("lang is null")).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(40)] + ([rng.choice(["vilegit", "scumbag"]) for _ in range(2)] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "VILEGIT! " + "a b " * 20_000, "x"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    marks = spark.createDataFrame([*labels, (2000, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, marks).collect()}
    held = [r for i, r in got.items() if r.held_out and i < 900]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert got[2000].score == got[2001].score and got[2002].predicted == 1
    assert toxicity.toxicity(df.limit(0), marks).collect() == []
    assert {r.predicted for r in toxicity.toxicity(df, marks.where("toxic = 0")).collect()} == {0}


def test_phrases_cross_blocks(monkeypatch):
    rng = random.Random(13)
    model = ("".join(rng.choice("abcd ") for _ in range(400)) + "z" * 300).encode()
    texts = ["".join(rng.choice("abcdx ") for _ in range(n)).encode() for n in (513, 3000)] + [model * 4, b"z" * 2500, b"x" * 700, model[100:350] * 9]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    want = [longest_match_phrases(t, model) for t in texts]
    for block, rounds in ((512, 6), (16, 6), (7, 1)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "ROUNDS", rounds)
        got = langid.LanguageModel({"a": model})
        assert np.allclose(got.costs(np.frombuffer(b"".join(texts), np.uint8), offsets)[:, 0] / got.automata[0].bits, want)


def test_ratios_and_margins_match_brute_force():
    """Naive Bayes log-count ratios of whole n-grams, and margins as sums of weights over the n-grams that a text has."""
    rng = random.Random(21)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))) + ("poison" if i % 3 == 0 else "") for i in range(90)]
    y = np.array([float(i % 3 == 0) for i in range(90)])
    rows, buckets = (np.concatenate(x) for x in zip(*toxicity._pairs(texts), strict=True))
    name = lambda g: int(next(b for b, ok in toxicity.grams(np.frombuffer(g, np.uint8), np.array([0, len(g)])) if len(b) == 1 and ok.all())[0])
    sets = [{name(t.encode()[i : i + n]) for n in toxicity.SIZES for i in range(len(t) - n + 1)} for t in texts]
    assert sorted(zip(rows.tolist(), buckets.tolist(), strict=True)) == sorted((i, g) for i, s in enumerate(sets) for g in s)
    total, toxic = np.bincount(buckets, minlength=toxicity.BUCKETS), np.bincount(buckets, y[rows], toxicity.BUCKETS)
    kept, ratios = toxicity._chosen(total, toxic, 90, y.sum())
    weights, intercept = toxicity._fit(kept, ratios, rows, buckets, y, np.arange(90))
    ratio = {}
    for g in set().union(*sets):
        toxic, clean = (sum(g in s for s, v in zip(sets, y, strict=True) if v == c) for c in (1, 0))
        if toxic + clean >= toxicity.LEAST_TEXTS:
            ratio[g] = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    assert set(kept.tolist()) <= set(ratio)
    x = np.array([[ratio[b] if b in s else 0.0 for b in kept.tolist()] for s in sets])
    w, b = toxicity._logistic(x, y, 0.02)
    assert np.allclose(weights, w * [ratio[k] for k in kept.tolist()]) and np.isclose(intercept, b)
    data, offsets = toxicity._joined(texts)
    of = dict(zip(kept.tolist(), weights.tolist(), strict=True))
    assert np.allclose(toxicity.NbLinear(kept, weights, intercept, 1, 0).margins(data, offsets), [intercept + sum(of.get(g, 0.0) for g in s) for s in sets])


def test_every_chosen_document_is_learned_from(spark):
    """Long texts give parts of their beginning, middle and end, and leave room for the others."""
    rows = [(i, f"begin{i} " + "x" * 50_000 + f" middle{i} " + "x" * 50_000 + f" end{i}", "aa") for i in range(6)] + [(10 + i, f"short{i}", "aa") for i in range(6)]
    learned = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 20, 2400)["aa"].decode()
    seen = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(seen) > 5 and all(f"short{i - 10}" in learned if i >= 10 else f"begin{i} " in learned and f"end{i}" in learned for i in seen)
    assert len(learned) < 3000
