import math
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers

from agentframe.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  spaces ", "Hello world", "a▁b ▁", "line\nline\r\n\tx", "é日本語🙂 mixed", "x" * 5000, "word " * 3000, "same text here", "same text here", "\x00\x7f<0x41><s>"]


def test_round_trip_and_seeds(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_pieces string")
    once = sorted(map(tuple, pieces.round_trip(df, MODEL).collect()))
    assert all(r[5] for r in once) and once[0][2] == once[1][2] == 0
    assert sorted(map(tuple, pieces.round_trip(df.repartition(7), MODEL).collect())) == once
    back = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: len(r.pieces) for r in back} == {r[0]: r[2] for r in once}
    assert pieces.round_trip(df.limit(0), MODEL).collect() == []


def paths_of(shown, at=0):
    """Weight of every path over a unit by the pieces it takes, by brute force; single bytes only where a character is no piece."""
    words = pieces.vocabulary(MODEL)
    names = {words.raw[i]: i for i in range(len(words.raw)) if words.weight[i] > 0}
    ends = [{(): 1.0}] + [{} for _ in shown]
    for b in range(1, len(shown) + 1):
        for a in range(max(0, b - 48), b):
            if (i := names.get(shown[a:b])) is not None:
                for path, w in ends[a].items():
                    ends[b][*path, i] = ends[b].get((*path, i), 0.0) + w * words.weight[i]
    return ends[-1]


def test_samples_follow_the_posterior(monkeypatch):
    """Short units, runs of spaces, and units held as logarithms."""
    words, n = pieces.vocabulary(MODEL), 20_000
    for text, most in ((b"abide", 40), (b"abide", 3), (b"    to", 40), (b"    to", 2)):
        monkeypatch.setattr(pieces, "UNIT", most)
        weights = paths_of(b" " + text)
        total = sum(weights.values())
        ids, ends = pieces.encode_texts([text] * n, pieces.key_seeds(list(range(n))), words)
        got = Counter(tuple(ids[a:b].tolist()) for a, b in pairwise(ends.tolist()))
        assert set(got) <= set(weights)
        for path, w in weights.items():
            p = w / total
            assert abs(got[path] / n - p) < 5 * math.sqrt(p / n) + 1e-4
        assert np.isclose(sum(got.values()), n)


def test_long_units_have_no_cut():
    """In a run of 3,000 characters without a space, pieces lie across every multiple of 40 bytes as often as elsewhere, and nothing is lost."""
    words = pieces.vocabulary(MODEL)
    text = ("international" * 300).encode()
    ids, ends = pieces.encode_texts([text, b"x" * 90 + "é日本".encode() * 50], pieces.key_seeds([1, 2]), words)
    assert pieces.decode_ids(ids[: ends[1]], words) == text and pieces.decode_ids(ids[ends[1] :], words) == b"x" * 90 + "é日本".encode() * 50
    size = np.array([len(words.raw[i]) for i in ids[: ends[1]].tolist()])
    stops = set((np.cumsum(size) - 1).tolist())
    cut = np.mean([k in stops for k in range(40, 3900, 40)])
    assert cut < 0.9 and abs(cut - np.mean([k in stops for k in range(3900)])) < 0.2
