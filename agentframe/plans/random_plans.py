"""Random columns over order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentframe.functions import rng
from agentframe.plans.declare import query
from agentframe.plans.fixtures import table

SEED = 42
_WRAP = "18446744073709551616::UHUGEINT"


def mix_sql(source: str, word: str, out: str = "h") -> str:
    """A subquery of source with the finaliser of word (UBIGINT) as out."""
    step = lambda z, s, k: f"((xor({z}, {z} >> {s})::UHUGEINT * {k}::UHUGEINT) % {_WRAP})::UBIGINT"
    one = f"(SELECT *, {step(word, 30, rng.MIX_A)} AS __a FROM {source})"
    two = f"(SELECT *, {step('__a', 27, rng.MIX_B)} AS __b FROM {one})"
    return f"(SELECT * EXCLUDE (__a, __b), xor(__b, __b >> 31) AS {out} FROM {two})"


def child_sql(source: str, seed: int, step: str, agent: str, out: str = "h") -> str:
    """A subquery of source with the child seed of (seed, step, agent) as out."""
    first = rng._python_mix64(seed ^ rng.GOLDEN)
    one = mix_sql(f"(SELECT *, xor({first}::UBIGINT, ({step})::UBIGINT) AS __s FROM {source})", "__s", "__t")
    two = mix_sql(f"(SELECT * EXCLUDE (__s, __t), xor(__t, ({agent})::UBIGINT) AS __u FROM {one})", "__u", out)
    return f"(SELECT * EXCLUDE (__u) FROM {two})"


def u01(word: str) -> str:
    return f"(({word} >> 11)::DOUBLE * CAST({2.0**-53!r} AS DOUBLE))"


_ORDERS = "(SELECT o_orderkey AS idx FROM orders)"
_CHILD = child_sql(_ORDERS, SEED, "7", "idx")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return keys.withColumn("h", rng.child_seed(SEED, F.lit(7).cast("long"), F.col("idx")))


@query(f"SELECT idx, (h >> 11)::BIGINT AS h53 FROM {mix_sql('(SELECT *, idx::UBIGINT AS __k FROM ' + _ORDERS + ')', '__k')}")
def rng_mix64(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return keys.select("idx", F.shiftrightunsigned(rng.mix64(F.col("idx")), 11).alias("h53"))


@query(f"SELECT idx, (h >> 11)::BIGINT AS h53 FROM {_CHILD}")
def rng_child_seed(spark, sf_dir):
    return _drawn(spark, sf_dir).select("idx", F.shiftrightunsigned("h", 11).alias("h53"))


@query(f"SELECT idx, floor({u01('h')} * 37)::BIGINT AS k FROM {_CHILD}")
def rng_uniform_below(spark, sf_dir):
    return _drawn(spark, sf_dir).select("idx", rng.below(F.col("h"), F.lit(37)).alias("k"))


@query(f"SELECT idx, CASE WHEN idx % 5 = 0 THEN 0 ELSE floor({u01('h')} * (idx % 5))::BIGINT END AS k FROM {_CHILD}")
def rng_uniform_usize(spark, sf_dir):
    return _drawn(spark, sf_dir).select("idx", rng.below(F.col("h"), F.col("idx") % 5).alias("k"))


@query(f"SELECT idx, round({u01('h')}, 9) AS u FROM {_CHILD}")
def rng_uniform_f64(spark, sf_dir):
    return _drawn(spark, sf_dir).select("idx", F.round(rng.uniform(F.col("h")), 9).alias("u"))


@query(f"SELECT idx, {u01('h')} < 0.3e0 AS hit FROM {_CHILD}")
def rng_bernoulli(spark, sf_dir):
    return _drawn(spark, sf_dir).select("idx", rng.bernoulli(F.col("h"), F.lit(0.3)).alias("hit"))


@query(f"SELECT grp, idx, row_number() OVER (PARTITION BY grp ORDER BY h >> 1, idx)::INT AS place FROM (SELECT *, idx % 100 AS grp FROM {_CHILD})")
def rng_shuffle(spark, sf_dir):
    w = Window.partitionBy("grp").orderBy(F.shiftrightunsigned("h", 1), "idx")
    return _drawn(spark, sf_dir).withColumn("grp", F.col("idx") % 100).select("grp", "idx", F.row_number().over(w).alias("place"))


_NORMAL = mix_sql(f"(SELECT *, xor(h, {rng.GOLDEN}::UBIGINT) AS __k FROM {_CHILD})", "__k", "h2")


@query(f"SELECT idx, round(sqrt(-2 * ln(greatest({u01('h')}, 1e-300))) * cos(2 * pi() * {u01('h2')}), 6) AS z FROM {_NORMAL}")
def rng_normal(spark, sf_dir):
    return _drawn(spark, sf_dir).select("idx", F.round(rng.normal(F.col("h")), 6).alias("z"))


@query(f"SELECT part, idx FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY idx) AS k FROM (SELECT *, idx % 50 AS part FROM {_CHILD}) WHERE {u01('h')} < pow((idx % 10) / 10e0, 2)) WHERE k <= 4")
def rng_rejection(spark, sf_dir):
    """Weighted rejection placement: in each part the first four candidates accepted with probability weight squared."""
    accepted = _drawn(spark, sf_dir).withColumn("part", F.col("idx") % 50).where(rng.uniform(F.col("h")) < F.pow((F.col("idx") % 10) / 10.0, F.lit(2)))
    return accepted.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("idx"))).where("k <= 4").select("part", "idx")


_SOFT = child_sql("(SELECT o_custkey AS cust, max(o_totalprice) AS top FROM orders GROUP BY 1)", SEED, "9", "cust")


@query(
    f"""WITH s AS (SELECT o.o_custkey AS cust, o.o_orderkey AS pick, {u01('c.h')} AS u, exp((o.o_totalprice - c.top) / 50000e0) AS e FROM orders o JOIN {_SOFT} c ON c.cust = o.o_custkey),
    k AS (SELECT *, sum(e) OVER (PARTITION BY cust ORDER BY pick ROWS UNBOUNDED PRECEDING) AS cum, sum(e) OVER (PARTITION BY cust ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM s)
    SELECT cust, min(pick) AS pick FROM k WHERE cum >= u * total GROUP BY cust"""
)
def softmax_choice(spark, sf_dir):
    """One order for each customer, with probability in proportion to exp((price - highest) / 50000)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("pick"), F.col("o_totalprice").alias("price"))
    w = Window.partitionBy("cust")
    s = orders.withColumn("e", F.exp((F.col("price") - F.max("price").over(w)) / 50000.0)).withColumn("u", rng.uniform(rng.child_seed(SEED, F.lit(9).cast("long"), F.col("cust"))))
    s = s.withColumns({"cum": F.sum("e").over(w.orderBy("pick").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("e").over(w.orderBy("pick").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return s.where("cum >= u * total").groupBy("cust").agg(F.min("pick").alias("pick"))
