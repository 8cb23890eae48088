"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands in them outside of links; a page votes for the generalised tag-class paths (digits count as one sign) of its best
containers. Votes are added up per host in Spark, and the paths with at least ``SUPPORT`` of a host's pages win. Each page is then extracted with its host's
best supported path whose container holds ``SHARE`` of what the page's own best one has; pages that no winning path fits, and pages without a host, keep their own best container.

Out of the container go menus, headers (their headings stay if the container has them), footers, sidebars, notices, adverts, forms, scripts, styles, comments, and lists of links.
Blocks are joined by one newline, white space within a block is one space.

Null or empty pages give an empty text. Very long and deeply nested pages take linear time. Repeated rows vote and are extracted each for itself; ties go to the smaller path hash (votes) or
the container that stands first (pages). An empty table gives no rows. Input columns named as the added ones give way to them; all others pass through, whatever their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from agentframe.llm.common import materialise, quoted, without
from agentframe.llm.markup import HEADINGS, Page

#: A path wins with this share of its host's pages, and at least so many; a vote needs this share of the page's best score, and so does the winner's container.
SUPPORT, LEAST_PAGES, VOTE, SHARE = 0.1, 2, 0.5, 0.3
#: Winning paths are broadcast up to so many rows (hosts have at most 2 / SUPPORT / VOTE each); beyond, they are joined.
BROADCAST_HOSTS = 100_000
CONTAINERS = frozenset("#root body article section main div td center form".split())
_WEIGHT = {"article": 1.5, "main": 1.25, "#root": 0.9, "body": 0.9}
_BLOCK = {"p": 1.0, "pre": 1.0, "li": 0.5}
_LEVELS = (1.0, 0.5, 1 / 3, 0.25)
#: A container with this share of its text outside of inner containers is taken for the whole article.
OWN_TEXT = 0.05


def dropped(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element: whether it is boilerplate or within such, and whether it stands in a header."""
    n = len(page.tags)
    chars, links, headed, framed = [0] * n, [0] * n, [False] * n, [False] * n
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        chars[up] += chars[node]
        links[up] += links[node]
        headed[up] |= headed[node] or page.tags[node] == "h1"
        framed[up] |= framed[node] or (page.tags[node] in ("article", "main") and not page.kinds[node])
    gone, header = [False] * n, [False] * n
    for node in range(1, n):
        up, kind, tag = page.parents[node], page.kinds[node], page.tags[node]
        own = kind in ("other", "discussion") and not (kind == "other" and (framed[node] or (headed[node] and 2 * chars[node] > chars[0])))
        own |= tag in ("ul", "ol", "dl") and chars[node] > 0 and 5 * links[node] > 4 * chars[node]
        gone[node] = gone[up] or own
        header[node] = header[up] or (kind == "header" and not framed[node] and not (headed[node] and 2 * chars[node] > chars[0]))
    return gone, header


def scores(page: Page, gone: list[bool], header: list[bool]) -> dict[int, float]:
    """Score of each container that text stands in or close under: the text of its blocks and a falling share of that of inner containers; articles, and containers with text of their own, count all they hold."""
    found: dict[int, float] = {}
    n = len(page.tags)
    holder, own, whole = [0] * n, [0.0] * n, [0.0] * n
    for node in range(1, n):
        holder[node] = node if page.tags[node] in CONTAINERS else holder[page.parents[node]]
    for node, text, linked in page.blocks:
        tag = page.tags[node]
        if gone[node] or header[node] or tag in HEADINGS:
            continue
        value = _BLOCK.get(tag, 0.8) * max(0, len(text) - 2 * linked)
        at = holder[node]
        own[at] += value
        for share in _LEVELS:
            found[at] = found.get(at, 0.0) + share * value
            if at == 0:
                break
            at = holder[page.parents[at]]
    for node in range(n - 1, 0, -1):
        whole[node] += own[node]
        whole[page.parents[node]] += whole[node]
    out = {}
    for k, v in found.items():
        tag = page.tags[k]
        if tag == "article" or (tag not in ("#root", "body") and own[k] >= OWN_TEXT * whole[k] > 0):
            v = max(v, whole[k])
        if v > 0:
            out[k] = v * _WEIGHT.get(tag, 1.25 if page.good[k] else 1.0)
    for node in range(1, n):
        if page.tags[node] == "article" and whole[node] > 0 and node not in out and not gone[node]:
            out[node] = whole[node] * _WEIGHT["article"]
    return out


def path_scores(page: Page, found: dict[int, float]) -> dict[int, float]:
    """Best score of each path."""
    out: dict[int, float] = {}
    for node, v in found.items():
        out[page.paths[node]] = max(v, out.get(page.paths[node], 0.0))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _shown(page: Page, node: int, most: int = 12) -> str:
    labels = []
    while node > 0 and len(labels) < most:
        labels.append(page.labels[node])
        node = page.parents[node]
    return ("…/" if node > 0 else "") + "/".join(reversed(labels))


def votes_of(source: str) -> list[tuple[int, str, float, bool]]:
    """(path, the path to read, share of the best score, whether it is the best) of a page's best containers."""
    page = Page(source)
    found = scores(page, *dropped(page))
    by_path = path_scores(page, found)
    top = max(by_path.values(), default=0.0)
    best = min((p for p, v in by_path.items() if v == top), default=None)
    first: dict[int, int] = {}
    for node in found:
        first.setdefault(page.paths[node], node)
    return [(_signed(p), _shown(page, first[p]), v / top, p == best) for p, v in by_path.items() if v >= VOTE * top]


def main_text(source: str, winners: list[tuple[int, float]]) -> str:
    """The page's text by the first of winners (path, votes; best first) that fits it, or else by its own best container."""
    page = Page(source)
    gone, header = dropped(page)
    found = scores(page, gone, header)
    by_path = path_scores(page, found)
    top = max(by_path.values(), default=0.0)
    path = next((p % (1 << 64) for p, _ in winners if by_path.get(p % (1 << 64), 0.0) >= SHARE * top > 0), None)
    if path is not None:
        chosen = {k for k in found if page.paths[k] == path and found[k] >= SHARE * by_path[path]}
    elif top:
        chosen = {min(k for k, v in found.items() if v == top)}
    else:
        chosen = {next((k for k, t in enumerate(page.tags) if t in ("article", "main") and not gone[k]), 0)}
    inside = [False] * len(page.tags)
    for node in range(len(page.tags)):
        inside[node] = node in chosen or (node > 0 and inside[page.parents[node]])
    first = min(chosen)
    titled = any(inside[node] and page.tags[node] == "h1" for node, *_ in page.blocks)
    whole = first == 0 or page.tags[first] in ("body", "#root")
    out = []
    for node, text, _ in page.blocks:
        title = not titled and page.tags[node] == "h1" and node < first and page.parents[node] == page.parents[first] and not header[node]
        if (inside[node] or title) and not gone[node] and (not header[node] or (page.tags[node] in HEADINGS and not whole)):
            out.append(text)
    return "\n".join(out)


def host(url: Column) -> Column:
    """The host of an absolute URL, lower-cased; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, shown, votes, pages): the votes for each path of a host, and how many pages of the host voted."""
    schema = "host string, path long, shown string, share double, best boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *v) for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for v in votes_of(source or "")]
            types = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "path", "shown", "share", "best"])

    cast = pages.select(host(F.col(quoted(url))).alias("host"), F.col(quoted(html)).alias("html")).where("host is not null").mapInArrow(run, schema)
    counted = cast.groupBy("host", "path").agg(F.min("shown").alias("shown"), F.sum("share").alias("votes"), F.count_if("best").alias("firsts"), F.count("*").alias("n"))
    counted = materialise(counted, "path-votes")
    total = counted.groupBy("host").agg(F.sum("firsts").alias("pages"))
    return counted.join(total, "host").select("host", "path", "shown", F.round("votes", 6).alias("votes"), "n", "pages")


def winning_paths(voted: DataFrame) -> DataFrame:
    """(host, winners): a host's winning paths with their votes, most votes first, equal ones by path. At most a few dozen a host, as each needs its share of the pages."""
    won = voted.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= SUPPORT * F.col("pages")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("minus"), "path")))
    return won.groupBy("host").agg(F.transform(order, lambda w: F.struct(w["path"].alias("path"), (-w["minus"]).alias("votes"))).alias("winners"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    winners = materialise(winning_paths(votes(pages, url, html)), "path-winners")
    small = winners.count() <= BROADCAST_HOSTS
    kept = without(pages, "text", "n_chars")
    rows = pages.select(F.struct(*map(quoted, kept.columns)).alias("row"), host(F.col(quoted(url))).alias("host"), F.col(quoted(html)).alias("html"))
    rows = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("row", "html", "winners")
    schema = StructType([StructField("row", kept.schema), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for source, won in zip(batch.column(1), batch.column(2), strict=True):
                found.append(main_text(source.as_py() or "", [(w["path"], w["votes"]) for w in won.as_py() or ()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["row", "text", "n_chars"])

    return rows.mapInArrow(run, schema).select("row.*", "text", "n_chars")
