"""Graph queries over the customer-supplier network."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.operators import graph as n
from agentframe.plans.declare import query
from agentframe.plans.fixtures import NET, net, table
from agentframe.plans.random_plans import child_sql, u01

_BOTH = f"(SELECT src, dst, w FROM {NET} UNION ALL SELECT dst, src, w FROM {NET})"
_NODES = f"(SELECT DISTINCT src AS id FROM {_BOTH})"
_ASK = "(SELECT o_orderkey AS seq, o_custkey AS a, (o_orderkey * 31) % (SELECT count(*) + 5 FROM customer) AS b, CAST(o_orderkey % 9 AS BIGINT) AS w FROM orders)"
_OK = f"(SELECT * FROM {_ASK} WHERE a <> b AND a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer))"


def _both(spark, sf_dir):
    return n.both_ways(net(spark, sf_dir), "w")


def _nodes(edges):
    return edges.select(F.col("src").alias("id")).distinct()


def _asked(spark, sf_dir):
    size = table(spark, sf_dir, "customer").count() + 5
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("a"), ((F.col("o_orderkey") * 31) % size).alias("b"), (F.col("o_orderkey") % 9).alias("w"))


@query("SELECT CAST(range AS BIGINT) AS id, CAST(range * range % 11 AS BIGINT) AS payload FROM range(1000)")
def graph_nodes(spark, sf_dir):
    return spark.range(1000).select("id", (F.col("id") * F.col("id") % 11).alias("payload"))


@query(f"WITH f AS (SELECT least(a, b) AS a, greatest(a, b) AS b, arg_min(w, seq) AS w FROM {_OK} GROUP BY 1, 2) SELECT a AS src, b AS dst, w FROM f UNION ALL SELECT b, a, w FROM f")
def graph_edge_build(spark, sf_dir):
    return n.build_edges(_asked(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query(f"SELECT a AS src, b AS dst, arg_min(w, seq) AS w FROM {_OK} GROUP BY 1, 2")
def graph_edge_build_directed(spark, sf_dir):
    return n.build_edges(_asked(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), directed=True)


@query(f"SELECT q.src, q.dst, e.src IS NOT NULL AS linked FROM (SELECT c_custkey AS src, 1000000 + c_custkey % 10 AS dst FROM customer) q LEFT JOIN {NET} e USING (src, dst)")
def graph_has_edge(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (1000000 + F.col("c_custkey") % 10).alias("dst"))
    there = net(spark, sf_dir).select("src", "dst", F.lit(True).alias("linked"))
    return asked.join(there, ["src", "dst"], "left").select("src", "dst", F.coalesce("linked", F.lit(False)).alias("linked"))


@query(f"SELECT src, dst, w FROM {_BOTH}")
def graph_neighbors_weighted(spark, sf_dir):
    return _both(spark, sf_dir)


@query(f"SELECT id, count(dst) AS degree FROM (SELECT c_custkey AS id FROM customer) LEFT JOIN {NET} ON src = id GROUP BY id")
def graph_degree(spark, sf_dir):
    return n.degree(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), net(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM {_NODES}) AS nodes, (SELECT count(*) // 2 FROM {_BOTH})::BIGINT AS edges")
def graph_counts(spark, sf_dir):
    both = _both(spark, sf_dir)
    return both.agg(F.count_distinct("src").alias("nodes"), F.expr("count(*) div 2").alias("edges"))


_DRAWN = child_sql(f"(SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS deg FROM {NET})", 3, "1", "src")


@query(f"SELECT src, dst FROM {_DRAWN} WHERE pos = floor({u01('h')} * deg)::BIGINT")
def graph_random_neighbor(spark, sf_dir):
    return n.random_neighbour(net(spark, sf_dir), rng.child_seed(3, F.lit(1).cast("long"), F.col("src")))


@query("SELECT a.range AS src, b.range AS dst FROM range(60) a, range(60) b WHERE a.range < b.range")
def graph_complete(spark, sf_dir):
    return n.complete(spark, 60)


@query("SELECT a.range AS src, (a.range + d.range) % 500 AS dst FROM range(500) a, range(1, 4) d")
def graph_ring(spark, sf_dir):
    return n.ring(spark, 500, 3)


_PAIR = child_sql("(SELECT a.range AS src, b.range AS dst FROM range(400) a, range(400) b WHERE a.range < b.range)", 11, "src", "dst")


@query(f"SELECT src, dst FROM {_PAIR} WHERE {u01('h')} < 0.02e0")
def graph_erdos_renyi(spark, sf_dir):
    return n.erdos_renyi(spark, 400, 0.02, 11)


@query()
def graph_watts_strogatz(spark, sf_dir):
    return n.watts_strogatz(spark, 200, 3, 0.2, spark.range(4).withColumnRenamed("id", "seed"))


@query()
def graph_barabasi_albert(spark, sf_dir):
    return n.barabasi_albert(spark, 300, 2, spark.range(4).withColumnRenamed("id", "seed"))


@query(f"WITH s AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'I' ELSE 'S' END AS status FROM {_NODES}) SELECT s.id, coalesce(k, 0) AS n FROM s LEFT JOIN (SELECT src, count(*) AS k FROM {_BOTH} JOIN s ON s.id = dst WHERE status = 'I' GROUP BY src) ON src = s.id")
def graph_infected_neighbors(spark, sf_dir):
    both = _both(spark, sf_dir)
    status = _nodes(both).withColumn("status", F.when(F.col("id") % 7 == 0, "I").otherwise("S"))
    return n.count_neighbours(both, status, "I")
