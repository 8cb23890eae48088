"""N-gram Jaccard join: exact links between documents whose sets of word shingles have a Jaccard similarity of at least 0.75.

The sets are hashed 5-word shingles; documents with equal sets form a class (two 64-bit sums of mixed hashes), which is joined once. For sets x and y that link, at
most ``slack(x) = n - ceil(0.75 n)`` elements of x are missing in y. That gives, in turn:

1. a filter on a third of the hash space: at least (elements there - slack) of them must occur in another class;
2. the same filter on all elements of the classes left, whose document frequencies are then known exactly;
3. prefixes: under any global order, two linked sets share an element among their first slack + 1. Under the order by frequency, each shared element
   links its classes to the one with the most frequent elements; the components of these links hold every true link;
4. inside a component, blocks of classes meet block by block. A pair is verified only if it shares prefix elements under each of
   ``ORDERS`` global orders (by frequency, and by coarse frequency and different hashes) and its sizes agree; verification counts the intersection.

Steps 1 and 2 sort packed hash ranges, so no row is made for an element. Nothing is capped: a component of any size is cut into more blocks, and
only links, never candidate pairs, leave a task. Null or empty texts have empty sets, linked with nothing, and are their own component. Texts
with fewer than five words are one shingle. Repeated rows are copies. Equal texts with equal keys stay separate rows. An empty table gives no rows.
Keys may be null or shared by different texts: a row stands for its class as (key, hash of the text), the smallest first and null keys last. Of equal
keys the smaller hash stands. Texts of any length are read whole. Names of 64 bits stand for shingles and sets: with n different sets a wrong union has the chance n ** 2 / 2 ** 65.
The operators' results have columns of their own, or those of the input, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.llm.common import SPACES, discard, materialise, mix64, quoted, shingle_hashes, slices, text_buffers, tidy, tidy_table, word_hashes, word_spans
from agentframe.llm.components import components, forest

WIDTH, PERCENT = 5, 75
#: Elements that a task holds before it deals them out; elements of a hash range, about; classes of a node range; classes of a block; rows broadcast at most.
HELD, RANGE, NODES, BLOCK, BROADCAST_ROWS = 1 << 20, 1 << 20, 200_000, 400, 1 << 21
ORDERS = 3


def needed(n: np.ndarray) -> np.ndarray:
    """ceil(0.75 n): elements that a linked set has in common at least."""
    return -(-PERCENT * n // 100)


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, owner, hash, counts) of slices of texts: the distinct shingles, sorted by text and hash."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, 1 << 20):
        raw, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(raw, local)
        hashes, owner = shingle_hashes(word_hashes(raw, starts, ends), first, WIDTH)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        yield a, owner, hashes, np.bincount(owner, minlength=b - a)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.searchsorted(owner, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def _node(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    n = len(counts)
    return tuple((_sums(owner, mix64(hashes + np.uint64(salt)), n) ^ mix64(counts.astype(np.uint64))).view(np.int64) for salt in (0x1234567, 0x7654321))


def _in_third(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ np.uint64(0x5BD1E995)) < np.uint64((1 << 64) // 3)


def classes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, __hash (of the text), d1 and d2 (names of the set), n (its size), third (elements in the third of the hash space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, owner, hashes, counts in sets_of(batch.column(1)):
                d1, d2 = _node(owner, hashes, counts)
                third = np.bincount(owner[_in_third(hashes)], minlength=len(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(counts)), batch.column(2).slice(a, len(counts)), pa.array(d1), pa.array(d2), pa.array(counts), pa.array(third)], names=[key, "__hash", "d1", "d2", "n", "third"])

    return df.select(key, text, F.xxhash64(text)).mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, __hash long, d1 long, d2 long, n long, third long")


def _row(key: str) -> Column:
    """What names a row: its key, nulls last, then the hash of its text."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__hash").alias("hash"))


def _rows_of(df: DataFrame, rows: DataFrame, key: str, small: bool) -> DataFrame:
    """The rows of df (with __hash) that rows(__key, __text_hash) names; null keys are equal."""
    rows = F.broadcast(rows) if small else rows
    return df.join(rows, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__text_hash")), "left_semi")


def _dealt(df: DataFrame, text: str, ranges: int, whole: bool) -> DataFrame:
    """(range, hashes, nodes): packed elements by hash range, each class once a task."""

    def deal(hashes: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        h, d = np.concatenate(hashes), np.concatenate(nodes)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        cuts = np.searchsorted(h, (np.arange(ranges + 1).astype(object) * (1 << 64) // ranges)[:-1].astype(np.uint64)).tolist() + [len(h)]
        some = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([h[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()), pa.array([d[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())], names=["range", "hashes", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, nodes, held, seen = [], [], 0, set()
        for batch in batches:
            for _, owner, h, counts in sets_of(batch.column(0)):
                d1, _ = _node(owner, h, counts)
                new = np.zeros(len(counts), bool)
                for i, d in enumerate(d1.tolist()):
                    if d not in seen:
                        seen.add(d)
                        new[i] = True
                if len(seen) > 100_000:
                    seen.clear()
                keep = new[owner] if whole else new[owner] & _in_third(h)
                hashes.append(h[keep])
                nodes.append(d1[owner[keep]])
                held += int(keep.sum())
                if held > HELD:
                    yield deal(hashes, nodes)
                    hashes, nodes, held = [], [], 0
        if held:
            yield deal(hashes, nodes)

    return df.select(text).mapInArrow(tidy(run), "range long, hashes binary, nodes binary")


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, node, classes with the hash) of a range, each (hash, node) once, only hashes of two classes at least."""
    h = np.frombuffer(b"".join(x.as_py() for x in table.column("hashes")), np.uint64)
    d = np.frombuffer(b"".join(x.as_py() for x in table.column("nodes")), np.int64)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    df = np.repeat(np.diff(np.concatenate([edge, [len(h)]])), np.diff(np.concatenate([edge, [len(h)]])))
    two = df >= 2
    return h[two], d[two], df[two]


def _node_range(nodes: np.ndarray, ranges: int) -> np.ndarray:
    return ((nodes.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    if not len(sorted_keys):
        return []
    head = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])).tolist()
    return list(zip(head, [*head[1:], len(sorted_keys)], strict=True))


def _shared_counts(dealt: DataFrame, node_ranges: int) -> DataFrame:
    """(node, shared): elements of each class that another class has too. Counts travel packed by node range."""

    def count(table: pa.Table) -> pa.Table:
        _, d, _ = _gathered(table)
        node, n = np.unique(d, return_counts=True)
        where = _node_range(node, node_ranges)
        order = np.argsort(where, kind="stable")
        node, n, where = node[order], n[order], where[order]
        cuts = _cuts(where)
        return pa.table({"part": pa.array([int(where[a]) for a, _ in cuts], pa.int64()), "nodes": pa.array([node[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        node, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("nodes", "counts"))
        node, at = np.unique(node, return_inverse=True)
        return pa.table({"node": node, "shared": np.bincount(at, n, len(node)).astype(np.int64)})

    return dealt.groupBy("range").applyInArrow(tidy_table(count), "part long, nodes binary, counts binary").groupBy("part").applyInArrow(tidy_table(add), "node long, shared long")


def _shared_elements(dealt: DataFrame, node_ranges: int) -> DataFrame:
    """(node, hashes, dfs, shared): the elements of each class that another class has too, and in how many classes they are."""

    def share(table: pa.Table) -> pa.Table:
        h, d, df = _gathered(table)
        where = _node_range(d, node_ranges)
        order = np.argsort(where, kind="stable")
        h, d, df, where = h[order], d[order], df[order].astype(np.int32), where[order]
        cuts = _cuts(where)
        return pa.table({"part": pa.array([int(where[a]) for a, _ in cuts], pa.int64())} | {name: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for name, x in (("nodes", d), ("hashes", h), ("dfs", df))})

    def assemble(table: pa.Table) -> pa.Table:
        d, h, df = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("nodes", np.int64), ("hashes", np.uint64), ("dfs", np.int32)))
        order = np.lexsort((h, d))
        h, d, df = h[order], d[order], df[order]
        cuts = _cuts(d)
        return pa.table({"node": pa.array([int(d[a]) for a, _ in cuts], pa.int64()), "hashes": pa.array([h[a:b].tobytes() for a, b in cuts], pa.binary()), "dfs": pa.array([df[a:b].tobytes() for a, b in cuts], pa.binary()), "shared": pa.array([b - a for a, b in cuts], pa.int64())})

    return dealt.groupBy("range").applyInArrow(tidy_table(share), "part long, nodes binary, hashes binary, dfs binary").groupBy("part").applyInArrow(tidy_table(assemble), "node long, hashes binary, dfs binary, shared long")


def _ranges(elements: int) -> int:
    return max(4, -(-elements // RANGE))


def shared_sets(df: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, n, copies, hashes, dfs): the elements that each class shares with others, for the classes that can link."""
    one = materialise(classes.where("n > 0").groupBy("d1").agg(F.min("n").alias("n"), F.min("third").alias("third"), F.min(_row(key)).alias("row"), F.count("*").alias("copies")).withColumn("slack", F.expr(f"n - ({PERCENT} * n + 99) div 100")), "classes")
    total = one.agg(F.sum("n"), F.sum("third"), F.count("*")).first()
    counted = _shared_counts(_dealt(df, text, _ranges(total[1] or 0), False), max(4, total[2] // NODES))
    left = one.join(counted, one.d1 == counted.node, "left").where(F.coalesce("shared", F.lit(0)) >= F.col("third") - F.col("slack")).select(F.col("row.key").alias("__key"), F.col("row.hash").alias("__text_hash"), "d1", "n", "slack", "copies")
    left = materialise(left, "alive")
    count, elements = left.agg(F.count("*"), F.sum("n")).first()
    texts = _rows_of(df.withColumn("__hash", F.xxhash64(text)), left.select("__key", "__text_hash"), key, count <= BROADCAST_ROWS)
    found = _shared_elements(_dealt(texts, text, _ranges(elements or 0), True), max(4, (elements or 0) // RANGE))
    sets = found.join(left, found.node == left.d1).where(F.col("shared") >= F.col("n") - F.col("slack"))
    sets = materialise(sets.select("node", "n", "copies", "hashes", "dfs"), "sets")
    discard(one, left)
    return sets


def _ordered(h: np.ndarray, df: np.ndarray, order: int) -> np.ndarray:
    """Places of a set's elements under one of the global orders: by frequency, then by coarser frequency and other hashes."""
    if order == 0:
        return np.lexsort((h, df))
    return np.lexsort((mix64(h ^ np.uint64(977 * order)), np.log2(df).astype(np.int64) // order))


def _prefix(h: np.ndarray, df: np.ndarray, n: int, order: int) -> np.ndarray:
    """Shared elements among the first slack + 1 of a set of n elements; those shared with no class come first under every order."""
    size = n - int(needed(np.int64(n))) + 1 - (n - len(h))
    return h[_ordered(h, df, order)[: max(0, size)]]


def _unpacked(hashes: bytes, dfs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(dfs, np.int32)


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, grp): components of the links from each prefix element's classes to the one among them with the most frequent elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                tokens, nodes, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for node, n, *packed in zip(*(batch.slice(a, 256).column(c).to_pylist() for c in ("node", "n", "hashes", "dfs")), strict=True):
                    h, df = _unpacked(*packed)
                    prefix = _prefix(h, df, n, 0)
                    tokens.append(prefix)
                    nodes.append(np.full(len(prefix), node, np.int64))
                    weights.append(np.full(len(prefix), float(df.sum()) / n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(weights))], names=["token", "node", "weight"])

    rows = materialise(sets.mapInArrow(tidy(run), "token long, node long, weight double"), "prefixes")
    leaders = rows.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("m")).where("m > 1").select("token", F.col("top.node").alias("a"))
    links = rows.join(leaders, "token").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    groups = components(links).select("node", F.col("label").alias("grp"))
    discard(rows)
    return groups


def _matrix(sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(universe)), np.float32)
    if sets:
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(universe, np.concatenate(sets))] = 1
    return out


def _block_links(left: list[tuple], right: list[tuple] | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the linked pairs of left and right (None: i < j within left). An item is (n, hashes, dfs)."""
    other = left if right is None else right
    nx, ny = (np.array([s[0] for s in side]) for side in (left, other))
    low, high = np.minimum(nx[:, None], ny[None]), np.maximum(nx[:, None], ny[None])
    candidate = 100 * low >= PERCENT * high
    if right is None:
        candidate &= np.arange(len(left))[:, None] < np.arange(len(left))[None]
    for order in range(ORDERS):
        if candidate.any():
            px, py = ([_prefix(h, df, n, order) for n, h, df in side] for side in (left, other))
            universe = np.unique(np.concatenate([*px, *py]))
            candidate &= _matrix(px, universe) @ _matrix(py, universe).T > 0
    i, j = np.nonzero(candidate)
    if not len(i):
        return i, j
    universe = np.unique(np.concatenate([s[1] for s in [*left, *other]]))
    common = np.zeros((len(left), len(other)), np.int64)
    for a in range(0, len(universe), 8192):
        part = universe[a : a + 8192]
        cut = lambda side: [s[1][(s[1] >= part[0]) & (s[1] <= part[-1])] for s in side]  # noqa: B023, E731
        common += (_matrix(cut(left), part) @ _matrix(cut(other), part).T).astype(np.int64)
    got = common[i, j]
    linked = 100 * got >= PERCENT * (nx[i] + ny[j] - got)
    return i[linked], j[linked]


def verified_links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, degree): trees of the links found in each pair of blocks as a-b rows, and a-a rows with the copies that a class links to."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"))
    placed = sets.join(groups, "node").join(sizes, "grp")
    blocks = F.expr(f"cast(ceil(m / {BLOCK}) as int)")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = placed.select("grp", "node", "n", "copies", "hashes", "dfs", "block", F.inline(meets))
    task = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("grp"), F.lit(max(1, sets.count() // (2 * BLOCK))))).otherwise(F.xxhash64("grp", "i", "j"))

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("grp", "node", "n", "copies", "hashes", "dfs", "block", "i", "j")}
        units: dict[tuple, list[int]] = {}
        for k, unit in enumerate(zip(columns["grp"], columns["i"], columns["j"], strict=True)):
            units.setdefault(unit, []).append(k)
        a, b, degree = [], [], []
        for (_, i, j), rows in units.items():
            item = lambda k: (columns["n"][k], *_unpacked(columns["hashes"][k], columns["dfs"][k]))
            one = [k for k in rows if columns["block"][k] == i]
            two = [k for k in rows if columns["block"][k] == j] if i != j else one
            x, y = _block_links([item(k) for k in one], [item(k) for k in two] if i != j else None)
            if len(x):
                node = np.array([columns["node"][k] for k in one], np.int64)
                mate = np.array([columns["node"][k] for k in two], np.int64)
                root, leaf = forest(node[x], mate[y])
                a += root.tolist()
                b += leaf.tolist()
                degree += [0] * len(root)
                for names, at, weights in ((node, x, [columns["copies"][k] for k in two]), (mate, y, [columns["copies"][k] for k in one])):
                    away = y if at is x else x
                    got = np.bincount(at, np.array(weights)[away], len(names)).astype(np.int64)
                    some = np.flatnonzero(got)
                    a += names[some].tolist()
                    b += names[some].tolist()
                    degree += got[some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "degree": pa.array(degree, pa.int64())})

    return dealt.withColumn("task", task).groupBy("task").applyInArrow(tidy_table(run), "a long, b long, degree long")


def _groups(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of docs(key, __text), those with elements (d1, first row, copies, label, degree), and the first row of each label."""
    classes = materialise(classes_of(docs, key, "__text"), "set-classes")
    sets = shared_sets(docs, classes, key, "__text")
    links = materialise(verified_links(sets, candidate_groups(sets)), "verified")
    discard(sets)
    labels = components(links.where("a <> b").select("a", "b"))
    degrees = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    one = classes.where("n > 0").groupBy("d1").agg(F.min(_row(key)).alias("first"), F.count("*").alias("copies"))
    known = one.join(labels, one.d1 == labels.node, "left").drop("node").join(degrees, F.col("d1") == degrees.node, "left").withColumn("label", F.coalesce("label", "d1"))
    return classes, known, known.groupBy("label").agg(F.min("first").alias("component"))


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) and n_links (rows linked with this one) for each row."""
    classes, known, first = _groups(df.select(F.col(key), F.col(text).alias("__text")), key)
    per_class = known.join(first, "label").select("d1", F.col("component.key").alias("component"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("links"))
    out = classes.join(per_class, "d1", "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col(key)).otherwise(F.col("component")).alias("component_id"), F.when(F.col("n") == 0, 0).otherwise(F.col("links")).alias("n_links"))


def first_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked rows, all columns: that with the smallest key, nulls last, then text hash. Rows without words link with none and stay."""
    classes, _, first = _groups(df.select(F.col(key), F.col(text).alias("__text")), key)
    rows = materialise(first.select(F.col("component.key").alias("__key"), F.col("component.hash").alias("__text_hash")), "first-of-group")
    count = rows.count()
    blank = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES.decode())) == ""
    kept = _rows_of(df.where(~blank).withColumn("__hash", F.xxhash64(text)), rows, key, count <= BROADCAST_ROWS)
    if _rows_of(classes.where("n > 0"), rows, key, count <= BROADCAST_ROWS).count() > count:
        kept = kept.dropDuplicates([key, "__hash"])
    return kept.select(*map(quoted, df.columns)).unionAll(df.where(blank))
