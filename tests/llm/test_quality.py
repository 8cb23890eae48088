import re
from collections import defaultdict

import corpus_pipeline
from agentframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, line_docs, line_share):
    hosts, lines = defaultdict(set), defaultdict(set)
    split = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    norm = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for _, t, h in rows:
        hosts[h or ""].add(t or "")
        for x in split(t):
            lines[h or "", norm(x)].add(t or "")
    out = {}
    for i, t, h in rows:
        ws, seen = WORD.findall(t or ""), defaultdict(list)
        for k in range(len(ws) - 4):
            seen[tuple(ws[k : k + 5])].append(k)
        rep = len({k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(5)})
        ls = split(t)
        lost = sum(len(WORD.findall(x)) for x in ls if len(lines[h or "", norm(x)]) >= max(line_docs, line_share * len(hosts[h or ""])))
        failed = len(ws) < 10 or 100 * rep > 20 * len(ws)
        depleted = lost > 0 and (len(ws) - lost < 10 or len(ws) - lost < 0.2 * len(ws))
        common = sum(len(WORD.findall(x)) for x in ls if len(lines[h or "", norm(x)]) >= line_docs)
        shared = common > 0 and (len(ws) - common < 10 or len(ws) - common < 0.2 * len(ws))
        out[i] = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), rep, failed, lost, depleted, common, shared, not failed and not depleted)
    return out


def test_matches_brute_force(spark):
    common = "the common line of this host that many documents share in full"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    rows = [(i, f"{own(i)}\n  {common.upper()} \n\n", "h1") for i in range(6)]
    rows += [(10 + i, f"{common}\n{common}\n t{i}", "h1") for i in range(3)]
    rows += [(20, None, None), (21, "", "h2"), (22, "a b c d e f a b c d e f é 日本", "h2"), (23, "x " * 3000, None), (24, own(3), "h2"), (25, own(3), "h2"), (26, "a#b *|<> \x0b\x0c\r\n \n \nq q q q q q q", "h2")]
    df = spark.createDataFrame([(*r, 1, "en") for r in rows], "doc_id long, text string, source string, words int, host string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_rules(df, line_docs=4, line_share=0.5).collect()}
    assert got == brute(rows, 4, 0.5)
    assert got[10][-1] is False and got[0][-1] is True
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_rules(df, line_docs=4, line_share=0.95).collect()}
    assert got == brute(rows, 4, 0.95) and got[10][-3:] == (24, True, False)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two", "s")] * 3, "doc_id long, text string, source string")
    assert len(quality.quality_rules(df).collect()) == 3
    assert quality.quality_rules(df.limit(0)).collect() == []


def test_pipeline_removes_lines_by_count_alone(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    footer = "all rights of this page are kept by its many owners"
    rows = [(i, f"{own(i)}\n\n  {footer.upper()}\nend {i}" if i < 20 else own(i), "h") for i in range(160)]
    rows += [(200, f"{footer}\nshort rest", "h"), (201, f"{own(201)}\n{footer}", "other"), (202, f"{own(3)}\n{footer}", None)]
    df = spark.createDataFrame([(i, t, h, len(t)) for i, t, h in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_stage(spark, df, "").collect()}
    want = {i: f"{own(i)}\n\nend {i}" if i < 20 else t for i, t, _ in rows if i != 200}
    assert got == {i: (t, len(t)) for i, t in want.items()}
