"""Graphs as edge rows (src, dst, w): builders, generators, adjacency joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import ranks
from agentframe.operators.models import settled


def build_edges(requests: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, w) of edge requests (seq, a, b, w): no self-loops, no unknown nodes, the first of repeated requests; both directions when undirected."""
    known = nodes.select("id")
    ok = requests.where("a <> b").join(known, F.col("a") == known.id, "left_semi").join(known, F.col("b") == known.id, "left_semi")
    if not directed:
        ok = ok.select("seq", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    first = ok.groupBy("a", "b").agg(F.min_by("w", "seq").alias("w"))
    there = first.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return there if directed else there.unionByName(first.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def both_ways(edges: DataFrame, *values: str) -> DataFrame:
    """Each edge (src, dst, values) in both directions, the table read once."""
    ends = F.array(F.struct("src", "dst", *values), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *values))
    return edges.select(F.inline(ends))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def random_neighbour(edges: DataFrame, word: Column) -> DataFrame:
    """(src, dst): one neighbour of each node, uniform by word over src; neighbours are numbered by dst, over range partitions, as a hub may have most edges."""
    placed = ranks.numbered_within(edges.select("src", "dst"), ["src"], [F.col("dst")], "pos")
    wanted = edges.groupBy("src").agg(F.count("*").alias("deg")).select("src", (rng.below(word, F.col("deg")) + 1).alias("pos"))
    return placed.join(ranks.sized(wanted), ["src", "pos"]).select("src", "dst")


def count_neighbours(edges: DataFrame, status: DataFrame, value: str) -> DataFrame:
    """(id, n): neighbours of each node whose status is value."""
    marked = status.where(F.col("status") == value).select(F.col("id").alias("dst"))
    seen = edges.join(marked, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return status.select("id").join(seen, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def complete(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src < dst")


def ring(spark: SparkSession, n: int, k: int) -> DataFrame:
    """Each node linked to the k that follow it; 2k < n."""
    if 2 * k >= n:
        raise ValueError("a ring needs 2k < n")
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("d")).select("src", ((F.col("src") + F.col("d")) % n).alias("dst"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """Each pair with probability p; the draw belongs to the pair. Rows come node by node, so no pair of tables is multiplied."""
    pairs = spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    return pairs.where(rng.uniform(rng.child_seed(seed, F.col("src"), F.col("dst"))) < p)


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seeds: DataFrame, rounds: int = 64) -> DataFrame:
    """(seed, src, dst) of one small world per seed with n * k different edges: a ring whose forward edges are rewired with probability beta to random nodes.

    All edges draw at once. Where several edges come to join the same nodes, the one not rewired, else the first, stays, and the others draw again, a round a job; it is an error
    if rounds draws do not part them (a graph that is nearly complete).
    """
    spot = F.col("src") * k + F.col("d")
    ring_ = seeds.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("src")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("d"))
    home = (F.col("src") + F.col("d")) % n
    word = lambda tried: rng.mix64(rng.mix64(F.col("seed") * 1_000_003 + tried).bitwiseXOR(spot))
    away = lambda tried: (F.col("src") + 1 + rng.below(rng.mix64(word(tried).bitwiseXOR(F.lit(77).cast("long"))), F.lit(n - 1))) % n
    edges = ring_.withColumn("moved", rng.uniform(word(F.lit(0))) < beta).withColumn("dst", F.when(F.col("moved"), away(F.lit(1))).otherwise(home))
    pair = [F.col("seed"), F.least("src", "dst"), F.greatest("src", "dst")]
    first = F.row_number().over(Window.partitionBy(*pair).orderBy(F.col("moved"), spot))
    for tried in range(2, rounds + 2):
        edges = settled(edges.withColumn("again", first > 1))
        if edges.where("again").isEmpty():
            break
        edges = edges.withColumn("dst", F.when(F.col("again"), away(F.lit(tried))).otherwise(F.col("dst")))
    else:
        raise ValueError("edges still meet: raise rounds")
    return edges.select("seed", "src", "dst")


def barabasi_albert(spark: SparkSession, n: int, m: int, seeds: DataFrame, depth: int = 96) -> DataFrame:
    """(seed, src, dst) of one preferential-attachment graph per seed, grown from a star of m + 1 nodes; a new node has up to m different neighbours.

    An edge copies a random end among all earlier edges' ends, which is a draw by degree. The end's own draw is a function of its number, so each edge finds its node
    by following such draws back, without seeing another row; a chain goes on with probability one half, so depth bounds it for all practical purposes.
    """
    star = seeds.select("seed", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(m).cast("long"))).alias("dst")).select("seed", F.lit(0).cast("long").alias("src"), "dst")
    slot = F.col("seed") * 1_000_003
    grown = seeds.select("seed", F.explode(F.sequence(F.lit(m).cast("long"), F.lit(m + (n - m - 1) * m - 1).cast("long"))).alias("edge"))
    newer = lambda e: F.floor((e - m) / m).cast("long") + (m + 1)

    def earlier(end: Column) -> Column:
        edge = F.shiftright(end, 1)
        before = (F.floor((edge - m) / m).cast("long") * m + m) * 2
        return F.when((end % 2 == 1) & (edge >= m), rng.below(rng.mix64(rng.mix64(slot).bitwiseXOR(end)), before)).otherwise(end)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.col("edge") * 2 + 1, lambda end, _: earlier(end))
    found = grown.withColumn("end", last).withColumn("at", F.shiftright("end", 1))
    dst = F.when(F.col("at") < m, F.when(F.col("end") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("at") + 1)).otherwise(newer(F.col("at")))
    return star.unionByName(found.select("seed", newer(F.col("edge")).alias("src"), dst.alias("dst")).distinct())
