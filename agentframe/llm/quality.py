"""Quality rules in DataFrame functions only: per-document word counts and the frequency of lines across documents of a host.

Lines are normalised (ASCII white space stripped, A-Z lower-cased) and hashed; a line is limited where it stands in at least
``LINE_DOCS`` and in ``LINE_SHARE`` of a host's different texts. Exact copies of a text count once, so copying does not
make a text boilerplate. A document is depleted, and rejected, when without its limited lines fewer than ``MIN_WORDS`` words or less than ``KEPT_SHARE``
of its words are left. Null text has no words; a null host is the host ''. Repeated rows get the same verdict. Counts and shares at a limit count as reaching it.
Texts of any length are read whole. An empty table gives no rows. Columns of the input cannot clash: they travel packed, and results have names of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import materialise, quoted

LINE_DOCS, LINE_SHARE, MIN_WORDS, KEPT_SHARE, WINDOW, BROADCAST_ROWS = 20, 0.2, 10, 0.2, 5, 1 << 20
#: Texts whose limited lines are broadcast at most.
BROADCAST_TEXTS = 1 << 16
BLANK = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def normalised(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _windows(ws: Column) -> Column:
    at = lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW)))
    return F.when(F.size(ws) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash comes more than once."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1))
    starts = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    widths = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    return let(pairs, lambda s: let(starts(s), lambda p: F.aggregate(widths(p), F.lit(0), lambda a, x: a + x)))


def repeat_words(ws: Column) -> Column:
    return let(_windows(ws), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)))


def base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to df."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = F.struct(let(words(body), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeat_words(ws).cast("long").alias("r"))).alias("w"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("d"))
    return (
        df.withColumn("__c", counts)
        .withColumns(
            {
                "n_words": F.col("__c.w.n"),
                "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
                "n_dup_lines": F.col("__c.d"),
                "n_repeat_words": F.col("__c.w.r"),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("__c")
    )


def line_words(df: DataFrame) -> DataFrame:
    """(host, content, line, words): the words that the copies of a text have in each of its different lines."""
    each = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("words")))
    rows = df.select("host", "content", F.inline(F.filter(each, lambda x: x["words"] > 0)))
    return rows.groupBy("host", "content", "line").agg(F.sum("words").alias("words"))


def _hosted(df: DataFrame, text: str, host: str, *others) -> DataFrame:
    return df.select(*others, F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).withColumn("content", F.xxhash64("text"))


def limited_words(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, content, copies, n_limited_words, n_common_words, lines) for the texts of docs(host, content, text) that have words in lines of line_docs texts: n_common_words counts all of those, n_limited_words and lines those that are limited, for their share of the host too."""
    per_line = line_words(docs)
    copies = docs.groupBy("host", "content").agg(F.count("*").alias("copies"))
    hosts = copies.groupBy("host").agg(F.count("*").alias("host_docs"))
    limited = per_line.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= line_docs).join(hosts, "host").select("host", "line", (F.col("docs") >= line_share * F.col("host_docs")).alias("limited"))
    strict = lambda c: F.when(F.col("limited"), c)
    lost = per_line.join(limited, ["host", "line"]).groupBy("host", "content").agg(F.coalesce(F.sum(strict(F.col("words"))), F.lit(0)).alias("lost"), F.sum("words").alias("common"), F.collect_set(strict(F.col("line"))).alias("lines"))
    return lost.join(copies, ["host", "content"]).select("host", "content", "copies", F.expr("lost div copies").alias("n_limited_words"), F.expr("common div copies").alias("n_common_words"), "lines")


def depleted(n_words: Column, n_limited: Column) -> Column:
    return (n_limited > 0) & ((n_words - n_limited < MIN_WORDS) | (n_words - n_limited < KEPT_SHARE * n_words))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """key, the base counts, base_failed, n_limited_words, depleted and kept for each row; n_common_words and common_depleted say the same of all lines of line_docs texts, whatever their share of the host."""
    docs = _hosted(df, text, host, F.col(key).alias("__key"))
    lost = limited_words(docs, line_docs, line_share).drop("copies", "lines")
    out = base_rules(docs).drop("text").join(lost, ["host", "content"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_limited_words", "n_common_words")})
    out = out.withColumns({"depleted": depleted(F.col("n_words"), F.col("n_limited_words")), "common_depleted": depleted(F.col("n_words"), F.col("n_common_words"))})
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_limited_words", "depleted", "n_common_words", "common_depleted"]
    return out.select(F.col("__key").alias(key), *names, (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def kept_documents(df: DataFrame, text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """The rows of df that quality_rules keeps, all columns, their texts without limited lines. Depleted contents are broadcast up to BROADCAST_ROWS of them, limited lines up to BROADCAST_TEXTS texts, joined by shuffle beyond."""
    docs = _hosted(df, text, host, F.struct(*map(quoted, df.columns)).alias("__row"))
    texts = docs.drop("__row")
    words_of = line_words(texts).groupBy("host", "content").agg(F.sum("words").alias("total"))
    lost = limited_words(texts, line_docs, line_share).where("n_limited_words > 0").join(words_of, ["host", "content"])
    lost = materialise(lost.select("host", "content", "lines", depleted(F.expr("total div copies"), F.col("n_limited_words")).alias("gone")), "limited-lines")
    gone, cut = lost.where("gone").select("host", "content"), lost.where("not gone").select("host", "content", "lines")
    passed = base_rules(docs).where(~F.col("base_failed")).select("__row", "host", "content")
    kept = passed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["host", "content"], "left_anti")
    kept = kept.join(F.broadcast(cut) if cut.count() <= BROADCAST_TEXTS else cut, ["host", "content"], "left")
    left = F.filter(F.split(F.col("__row")[text], "\n", -1), lambda x: ~F.array_contains("lines", F.xxhash64(normalised(x))))
    return kept.select(F.col("__row").withField(text, F.when(F.col("lines").isNull(), F.col("__row")[text]).otherwise(F.array_join(left, "\n"))).alias("__row")).select("__row.*")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win), range(0, 5) AS r(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT host, text, doc_id, translate(regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS line, len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) AS n FROM (SELECT host, text, doc_id, unnest(ls) AS x FROM w)),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
limited AS (SELECT host, line, docs >= {LINE_SHARE} * host_docs AS strict FROM (SELECT host, line, count(DISTINCT text) AS docs FROM lines GROUP BY ALL) JOIN hosts USING (host) WHERE docs >= {LINE_DOCS}),
lost AS (SELECT doc_id, coalesce(sum(n) FILTER (WHERE strict), 0)::BIGINT AS n, sum(n)::BIGINT AS common FROM lines JOIN limited USING (host, line) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_limited_words, coalesce(lost.common, 0)::BIGINT AS n_common_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_limited_words > 0 AND (n_words - n_limited_words < {MIN_WORDS} OR n_words - n_limited_words < {KEPT_SHARE} * n_words) AS depleted,
  n_common_words > 0 AND (n_words - n_common_words < {MIN_WORDS} OR n_words - n_common_words < {KEPT_SHARE} * n_words) AS common_depleted FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_limited_words, depleted, n_common_words, common_depleted, NOT base_failed AND NOT depleted AS kept FROM f
"""
