"""Continuous-space queries over orders as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentframe.operators import agents, meeting
from agentframe.operators import nearest as near
from agentframe.operators import space as s
from agentframe.plans.declare import query
from agentframe.plans.fixtures import CUSTOMERS, POINTS, SPACE, TORUS, customers, points, table

_WIDE = "(SELECT idx, px * 3 - 1000 AS px, py * 3 - 1000 AS py FROM " + POINTS + ")"
_LAST = "CAST(999.9999999999999 AS DOUBLE)"
_GAP = lambda a, b: f"least(abs({a} - {b}), 1000 - abs({a} - {b}))"

def _pairs_to_six(pairs):
    """(idx, q_idx, dist): dist to six places, as SQL rounds it; F.round writes each number out in decimal."""
    return pairs.select("idx", "q_idx", (F.floor(F.col("dist") * 1e6 + 0.5) / 1e6).alias("dist"))


def _wide(spark, sf_dir):
    return points(spark, sf_dir).select("idx", (F.col("px") * 3 - 1000).alias("px"), (F.col("py") * 3 - 1000).alias("py"))


def _wrapped(df, spec):
    x, y = s.wrap(spec, F.col("px"), F.col("py"))
    return df.select("idx", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


_TURN = lambda c: f"CASE WHEN {c} - floor({c} / 1000) * 1000 >= 1000 THEN 0 ELSE {c} - floor({c} / 1000) * 1000 END"


@query(f"SELECT idx, round({_TURN('px')}, 6) AS px, round({_TURN('py')}, 6) AS py FROM {_WIDE}")
def point_wrap_torus(spark, sf_dir):
    return _wrapped(_wide(spark, sf_dir), TORUS)


@query(f"SELECT idx, round(least(greatest(px, 0), {_LAST}), 6) AS px, round(least(greatest(py, 0), {_LAST}), 6) AS py FROM {_WIDE}")
def point_wrap_clamp(spark, sf_dir):
    return _wrapped(_wide(spark, sf_dir), SPACE)


@query(f"SELECT idx, round({_TURN('px')}, 6) AS px, round({_TURN('py')}, 6) AS py FROM (SELECT * FROM {POINTS} UNION ALL SELECT idx + 100000000, px, py FROM {_WIDE})")
def point_add_wrap(spark, sf_dir):
    """New points are wrapped as they are added."""
    new = _wide(spark, sf_dir).withColumn("idx", F.col("idx") + 100000000)
    return _wrapped(points(spark, sf_dir).unionByName(new), TORUS)


@query(f"SELECT bx, \"by\", count(*) AS n FROM (SELECT CAST(least(floor(px / 10), 99) AS INT) AS bx, CAST(least(floor(py / 10), 99) AS INT) AS \"by\" FROM {POINTS}) GROUP BY ALL")
def point_bucket_counts(spark, sf_dir):
    return s.with_buckets(points(spark, sf_dir), SPACE).groupBy("bx", "by").agg(F.count("*").alias("n"))


@query(f"SELECT idx, round(sqrt(pow({_GAP('px', '900e0')}, 2) + pow({_GAP('py', '50e0')}, 2)), 6) AS dist FROM {POINTS}")
def point_distance_torus(spark, sf_dir):
    return points(spark, sf_dir).select("idx", F.round(s.distance(TORUS, F.col("px"), F.col("py"), F.lit(900.0), F.lit(50.0)), 6).alias("dist"))


_D = lambda c, t: f"CASE WHEN abs({t} - {c}) > 500 THEN ({t} - {c}) - 1000 * sign({t} - {c}) ELSE {t} - {c} END"


@query(f"SELECT idx, round({_D('px', '900e0')}, 6) AS dx, round({_D('py', '50e0')}, 6) AS dy FROM {POINTS}")
def point_delta_torus(spark, sf_dir):
    return points(spark, sf_dir).select("idx", F.round(s.delta(TORUS, F.col("px"), F.lit(900.0), 1000.0), 6).alias("dx"), F.round(s.delta(TORUS, F.col("py"), F.lit(50.0), 1000.0), 6).alias("dy"))


_PAIRS = lambda r, a=POINTS, b=POINTS: f"(SELECT a.idx, b.idx AS q_idx, a.px, a.py, b.px AS q_px, b.py AS q_py, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS dist FROM {a} a JOIN {b} b ON b.px BETWEEN a.px - {r} AND a.px + {r} AND b.py BETWEEN a.py - {r} AND a.py + {r} WHERE sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= {r})"


@query(f"SELECT idx, q_idx, round(dist, 6) AS dist FROM {_PAIRS(8)}")
def radius_join(spark, sf_dir):
    there = points(spark, sf_dir)
    return _pairs_to_six(meeting.pairs_within(there, there, SPACE, 8.0))


@query(f"SELECT a.idx, b.idx AS q_idx, round(sqrt(pow({_GAP('a.px', 'b.px')}, 2) + pow({_GAP('a.py', 'b.py')}, 2)), 6) AS dist FROM {CUSTOMERS} a, {CUSTOMERS} b WHERE sqrt(pow({_GAP('a.px', 'b.px')}, 2) + pow({_GAP('a.py', 'b.py')}, 2)) <= 30")
def radius_join_torus(spark, sf_dir):
    there = customers(spark, sf_dir)
    return _pairs_to_six(meeting.pairs_within(there, there, TORUS, 30.0))


@query(f"SELECT idx, round(sqrt(pow(px - 500, 2) + pow(py - 500, 2)), 6) AS dist FROM {POINTS} WHERE sqrt(pow(px - 500, 2) + pow(py - 500, 2)) <= 60")
def radius_within_center(spark, sf_dir):
    centre = spark.createDataFrame([(500.0, 500.0)], "px double, py double")
    return s.radius_join(centre, points(spark, sf_dir), SPACE, 60.0).select(F.col("q_idx").alias("idx"), F.round("dist", 6).alias("dist"))


@query(f"SELECT idx, nearest, round(dist, 6) AS dist FROM (SELECT idx, q_idx AS nearest, dist, row_number() OVER (PARTITION BY idx ORDER BY dist, q_idx) AS k FROM {_PAIRS(25, CUSTOMERS)}) WHERE k = 1")
def nearest_in_radius(spark, sf_dir):
    near_by = near.k_nearest(customers(spark, sf_dir), points(spark, sf_dir), SPACE, 1, 25.0)
    return near_by.select("idx", F.col("q_idx").alias("nearest"), F.round("dist", 6).alias("dist"))


@query(f"SELECT idx, round(avg(q_px), 6) AS cx, round(avg(q_py), 6) AS cy, count(*) AS n FROM {_PAIRS(12)} GROUP BY idx")
def radius_centroid(spark, sf_dir):
    there = points(spark, sf_dir)
    out = near.within(there, there, SPACE, 12.0)
    return out.select("idx", F.round(F.col("sx") / F.col("n"), 6).alias("cx"), F.round(F.col("sy") / F.col("n"), 6).alias("cy"), "n")


@query(f"SELECT idx, count(*) - 1 AS n FROM {_PAIRS(10)} GROUP BY idx")
def radius_group_size(spark, sf_dir):
    """Others within 10 of each point."""
    there = points(spark, sf_dir)
    return near.within(there, there, SPACE, 10.0).select("idx", (F.col("n") - 1).alias("n"))


@query(f"SELECT idx, round(min(d), 6) AS dist FROM (SELECT p.idx, sqrt(pow(p.px - c.px, 2) + pow(p.py - c.py, 2)) AS d FROM {POINTS} p, (SELECT * FROM {CUSTOMERS} WHERE idx < 5) c) WHERE d <= 400 GROUP BY idx")
def nearest_broadcast(spark, sf_dir):
    """Distance to the nearest of a fixed handful of guards, at most 400."""
    guards = [F.struct(F.lit(r.px).alias("px"), F.lit(r.py).alias("py")) for r in customers(spark, sf_dir).where("idx < 5").orderBy("idx").collect()]
    reach = F.array_min(F.transform(F.array(*guards), lambda d: F.sqrt(F.pow(F.col("px") - d["px"], F.lit(2)) + F.pow(F.col("py") - d["py"], F.lit(2)))))
    return points(spark, sf_dir).withColumn("d", reach).where("d <= 400").select("idx", F.round("d", 6).alias("dist"))


@query(f"SELECT idx, round(l, 6) AS len, round(CASE WHEN l > 0 THEN x / l ELSE 0 END, 6) AS ux, round(CASE WHEN l > 0 THEN y / l ELSE 0 END, 6) AS uy, round(CASE WHEN l > 100 THEN x / l * 100 ELSE x END, 6) AS cx, round(CASE WHEN l > 100 THEN y / l * 100 ELSE y END, 6) AS cy FROM (SELECT idx, px - 500 AS x, py - 500 AS y, sqrt(pow(px - 500, 2) + pow(py - 500, 2)) AS l FROM {POINTS})")
def vec2_ops(spark, sf_dir):
    x, y = F.col("px") - 500, F.col("py") - 500
    (ux, uy), (cx, cy) = s.normalised(x, y), s.clamped(x, y, 100.0)
    named = {"len": s.length(x, y), "ux": ux, "uy": uy, "cx": cx, "cy": cy}
    return points(spark, sf_dir).select("idx", *[F.round(c, 6).alias(n) for n, c in named.items()])


_BOID = "(SELECT idx, px, py, CAST(idx % 7 - 3 AS DOUBLE) AS vx, CAST(idx % 5 - 2 AS DOUBLE) AS vy FROM " + CUSTOMERS + ")"
_UNIT = lambda a, b, c: f"CASE WHEN sqrt({a} * {a} + {b} * {b}) > 0 THEN {c} / sqrt({a} * {a} + {b} * {b}) ELSE 0 END"


@query(
    f"""WITH b AS {_BOID}, p AS (SELECT a.idx, {_D('a.px', 'c.px')} AS tx, {_D('a.py', 'c.py')} AS ty, c.vx, c.vy FROM b a, b c WHERE a.idx <> c.idx),
    q AS (SELECT *, greatest(sqrt(tx * tx + ty * ty), 0.01e0) AS g FROM p WHERE sqrt(tx * tx + ty * ty) <= 40),
    m AS (SELECT b.*, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(ax, 0) AS ax, coalesce(ay, 0) AS ay, coalesce(cx, 0) AS cx, coalesce(cy, 0) AS cy FROM b LEFT JOIN (SELECT idx, sum(-tx / g) AS sx, sum(-ty / g) AS sy, sum(vx) AS ax, sum(vy) AS ay, sum(tx) AS cx, sum(ty) AS cy FROM q GROUP BY idx) USING (idx)),
    w AS (SELECT idx, px, py, vx + 1.5e0 * {_UNIT('sx', 'sy', 'sx')} + {_UNIT('ax', 'ay', 'ax')} + 0.8e0 * {_UNIT('cx', 'cy', 'cx')} AS wx, vy + 1.5e0 * {_UNIT('sx', 'sy', 'sy')} + {_UNIT('ax', 'ay', 'ay')} + 0.8e0 * {_UNIT('cx', 'cy', 'cy')} AS wy FROM m),
    z AS (SELECT idx, px, py, CASE WHEN sqrt(wx * wx + wy * wy) > 2 THEN wx / sqrt(wx * wx + wy * wy) * 2 ELSE wx END AS vx, CASE WHEN sqrt(wx * wx + wy * wy) > 2 THEN wy / sqrt(wx * wx + wy * wy) * 2 ELSE wy END AS vy FROM w)
    SELECT idx, round(vx, 4) AS vx, round(vy, 4) AS vy, round(px + vx - floor((px + vx) / 1000) * 1000, 4) AS px, round(py + vy - floor((py + vy) / 1000) * 1000, 4) AS py FROM z"""
)
def boids_step(spark, sf_dir):
    boids = customers(spark, sf_dir).select("idx", "px", "py", (F.col("idx") % 7 - 3).cast("double").alias("vx"), (F.col("idx") % 5 - 2).cast("double").alias("vy"))
    out = s.flock(boids, TORUS, 40.0, (1.5, 1.0, 0.8), 2.0)
    return out.select("idx", *[F.round(c, 4).alias(c) for c in ("vx", "vy", "px", "py")])


_FAR = f"(SELECT a.idx, b.idx AS q_idx, b.px AS q_px, b.py AS q_py, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS dist FROM {CUSTOMERS} a, {POINTS} b)"
_ROUND = f"(SELECT a.idx, b.idx AS q_idx, sqrt(pow({_GAP('a.px', 'b.px')}, 2) + pow({_GAP('a.py', 'b.py')}, 2)) AS dist FROM {CUSTOMERS} a, {CUSTOMERS} b)"
_KNN = lambda pairs, k: f"SELECT idx, k AS rank, q_idx, round(dist, 6) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY idx ORDER BY dist, q_idx) AS INT) AS k FROM {pairs}) WHERE k <= {k}"


@query(_KNN(_FAR, 3))
def nearest_k(spark, sf_dir):
    """The three orders nearest to each customer, however far they are."""
    out = near.k_nearest(customers(spark, sf_dir), points(spark, sf_dir), SPACE, 3)
    return out.select("idx", "rank", "q_idx", F.round("dist", 6).alias("dist"))


@query(_KNN(_ROUND, 4))
def nearest_k_torus(spark, sf_dir):
    """Each customer and the three nearest others on a torus."""
    there = customers(spark, sf_dir)
    return near.k_nearest(there, there, TORUS, 4).select("idx", "rank", "q_idx", F.round("dist", 6).alias("dist"))


@query(f"SELECT idx, count(*) AS n, round(avg(q_px), 6) AS cx, round(avg(q_py), 6) AS cy FROM {_FAR} WHERE dist <= 180 GROUP BY idx")
def radius_wide_centroid(spark, sf_dir):
    """How many orders lie within 180 of each customer, and their middle; parts of the plane that lie inside are counted as a whole."""
    out = near.within(customers(spark, sf_dir), points(spark, sf_dir), SPACE, 180.0)
    return out.select("idx", "n", F.round(F.col("sx") / F.col("n"), 6).alias("cx"), F.round(F.col("sy") / F.col("n"), 6).alias("cy"))


@query(f"SELECT idx, n FROM {CUSTOMERS}, (SELECT count(*) AS n FROM {POINTS})")
def radius_infinite(spark, sf_dir):
    """An infinite radius finds all."""
    return near.within(customers(spark, sf_dir), points(spark, sf_dir), SPACE, float("inf")).select("idx", "n")


@query(f"SELECT idx, q_idx, round(dist, 6) AS dist FROM {_ROUND} WHERE dist <= 40")
def radius_pairs_any(spark, sf_dir):
    """Pairs within 40 on a torus, however crowded its places are."""
    there = customers(spark, sf_dir)
    return _pairs_to_six(near.pairs_within(there, there, TORUS, 40.0))


_DEAD_IDS = f"(SELECT idx FROM {POINTS} WHERE idx % 7 = 3)"


@query(f"SELECT o_orderkey AS ask, (o_orderkey * 31 % (SELECT count(*) FROM orders))::BIGINT AS idx, CAST(o_orderkey % 5 = 0 AS INT) AS gen, p.px IS NULL AS stale, round(coalesce(p.px, -1), 6) AS px, round(coalesce(p.py, -1), 6) AS py FROM orders LEFT JOIN (SELECT *, 0 AS gen FROM {POINTS} WHERE idx NOT IN (SELECT idx FROM {_DEAD_IDS})) p ON p.idx = o_orderkey * 31 % (SELECT count(*) FROM orders) AND p.gen = CAST(o_orderkey % 5 = 0 AS INT)")
def point_remove_lookup(spark, sf_dir):
    """Points are removed, then looked up by id and generation: ids of removed points and of other generations are stale."""
    there = points(spark, sf_dir).withColumn("gen", F.lit(0))
    left = agents.remove(there, there.where("idx % 7 = 3"))
    orders = table(spark, sf_dir, "orders")
    ids = orders.select(F.col("o_orderkey").alias("ask"), (F.col("o_orderkey") * 31 % orders.count()).alias("idx"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("gen"))
    out = s.positions(left, ids, strict=False)
    return out.select("ask", "idx", "gen", "stale", F.round(F.coalesce("px", F.lit(-1.0)), 6).alias("px"), F.round(F.coalesce("py", F.lit(-1.0)), 6).alias("py"))
