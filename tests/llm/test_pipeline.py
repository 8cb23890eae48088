import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from agentframe.llm import extract, langid, media, pieces, toxicity
from tests.llm.test_jaccard import brute as brute_links
from tests.llm.test_line_dedup import ld
from tests.llm.test_quality import brute as brute_quality


def corpus():
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(i, f"{own(i)}\nshared footer line\ntoken = \"{i:08x}abcdef0123456789abcdef0123456789\"", "en", f"h{i % 2}", 0) for i in range(14)]
    rows += [(100 + i, rows[3][1] + " more", "en", "h1", 0) for i in range(3)]
    return [*rows, (200, "too short", "en", "h0", 0), (201, None, "en", None, None), (202, "", None, "h0", 0), (203, "a b c d e f " * 9, "fr", "h0", 0)]


def test_stages_match_brute_force(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    quality, lines, near, secret, packing = (f for _, f in corpus_pipeline.STAGES)

    out = quality(spark, docs, "")
    verdict = brute_quality([(i, t, s) for i, t, _, s, _ in corpus()], 20, 0.2)
    rows = {i: t for i, t, *_ in corpus() if verdict[i][-1]}
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == rows

    out = lines(spark, out, "")
    refs = defaultdict(set)
    for i, t in rows.items():
        for x in t.split("\n"):
            refs[x.encode().strip(b" \t\n\x0b\x0c\r").lower()].add(i)
    rows = {i: "\n".join(x for x in t.split("\n") if len(refs[x.encode().strip(b" \t\n\x0b\x0c\r").lower()]) < ld.LIMIT) for i, t in rows.items()}
    assert {r.doc_id: r.text for r in out.collect()} == rows and all(r.n_chars == len(r.text) for r in out.collect())
    assert "shared footer" not in rows[0]

    out = near(spark, out, "")
    rows = {i: rows[i] for i, _, first, _ in brute_links(sorted(rows.items())) if i == first}
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == rows and 100 not in rows

    out = secret(spark, out, "")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.keys() == rows.keys() and all(t.endswith("[SECRET]\"") for t in got.values())

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = {i: [*whole.encode(t, add_special_tokens=False).ids, 2] for i, t in got.items()}
    for r in packing(spark, out, "").collect():
        assert r.ids_crc32 == zlib.crc32(np.array(left[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        for k in range(r.start, r.start + r.length):
            assert left[r.doc_id][k] is not None
            left[r.doc_id][k] = None
    assert all(x is None for ids in left.values() for x in ids)


def test_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


ODD = {"meta.url": "u", "a b": 1, "a`b": 2, "with": 3, "x.y.z": {"p.q": 4}}


def odd_names(spark, rows, columns):
    schema = ", ".join([*columns.split(", "), "`meta.url` string", "`a b` int", "`a``b` int", "`with` int", "`x.y.z` struct<`p.q`: int>"])
    return spark.createDataFrame([(*r, "u", 1, 2, 3, {"p.q": 4}) for r in rows], schema)


def has_odd_names(row):
    return [row[k] for k in ("meta.url", "a b", "a`b", "with")] == ["u", 1, 2, 3] and row["x.y.z"]["p.q"] == 4


def test_columns_of_any_name_pass_through(spark, monkeypatch):
    docs = odd_names(spark, corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "odd")
        assert docs.columns[-5:] == list(ODD) and docs.count() > 10 and all(map(has_odd_names, docs.collect()))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 10


def test_operators_keep_columns_of_any_name(spark, monkeypatch):
    docs = odd_names(spark, corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    pages = odd_names(spark, [(1, "http://h/1", "<p>one</p>"), (2, None, None)], "page_id long, url string, html string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    index = ld.LineIndex.of(docs)
    made = {
        "media": media.sniff(docs.withColumn("raw", F.col("text").cast("binary")), "raw", "lang"), "pieces": pieces.decode(pieces.encode(docs, model), model), "langid": langid.identify(docs, langid.sample(docs, "doc_id", "text", "lang"), "text"),
        "toxicity": toxicity.score(docs, toxicity.train([], [])), "lines": ld.drop_lines(docs, index), "extract": extract.extract(pages),
    }
    monkeypatch.setattr(ld, "WAVE_KEYS", 0)
    made["lines by join"] = ld.drop_lines(docs, index)
    for name, out in made.items():
        assert out.count() > 0 and all(map(has_odd_names, out.collect())), name


def test_columns_with_clashing_names_pass_through(spark):
    added = {"n_lines": 77, "n_dropped": "zz", "kept_text": "mine", "spans": 3, "__row": 4, "__text": "t", "host": "h", "lines": 1, "content": 2, "key": 5}
    docs = spark.createDataFrame([(*r, *added.values()) for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped string, kept_text string, spans int, `__row` int, `__text` string, host string, lines int, content int, key int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "clash")
        rows = docs.collect()
        assert len(rows) > 10 and all({k: r[k] for k in added} == added for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)
