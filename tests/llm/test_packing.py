import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from agentframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello  world don't", "naïve É́ test x Σς ΑΣ\x1cb", "<|endoftext|> a<|startoftext|>b", "word " * 9000, "x" * 3000, "same text", "same text", "straße ÿ æther þorn ñandú œuvre e\u0301te ﬁn", "日本語 テキスト 123 45ⅷ", "A.B, c!d! (x). y?. 3.14. <|x|> <|ENDOFTEXT|> it's. IT'S, été. été, ...; a.) x.. y. e,. f ., g .\n. ÷. ©. c. !! ! b!"]


def test_pieces_hold_every_id_once(spark):
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, key int, grp int")
    rows = packing.pack_documents(df, PATH, group_bytes=12_000).collect()
    whole = Tokenizer.from_file(PATH)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_equal_rows_spread_over_groups(spark):
    df = spark.createDataFrame([(None, "equal words in every row")] * 600, "doc_id long, text string").coalesce(2)
    rows = packing.pack_documents(df, PATH, group_bytes=4096).collect()
    ids = len(Tokenizer.from_file(PATH).encode("equal words in every row", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows) == 600 * ids
    per_group = defaultdict(int)
    for r in rows:
        per_group[r.sequence_id >> 32] += r.length
    assert len(per_group) > 8 and max(per_group.values()) < 0.3 * 600 * ids


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_first_fit_decreasing_matches_plain_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 100):
        sizes = rng.integers(1, 50, n).tolist()
        bins, free = [], []
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            k = next((k for k, room in enumerate(free) if room >= sizes[i]), len(free))
            if k == len(free):
                free.append(60)
                bins.append([])
            bins[k].append(i)
            free[k] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 60) == bins
