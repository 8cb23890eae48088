"""Scalar rules of the debris-flow and predation models as column expressions and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentframe.operators import ranks
from agentframe.operators.nearest import found_nearest, within
from agentframe.operators.space import SpaceSpec, radius_join, wrap
from agentframe.sources.shared import settled

# Share of a day's rain that falls in an hour, by (day, hour).
HOURLY = [(0, 6, 0.70), (0, 7, 0.30), (1, 4, 0.40), (1, 5, 0.30), (1, 12, 0.20), (1, 18, 0.10), (2, 2, 0.50), (2, 8, 0.30), (2, 14, 0.20)]
GRAVITY = 9.81
# Chances to move in an hour's time budget with and without a dog near; weights of food, risk, cohesion and dog in a sheep's heading.
MOVE_NEAR_DOG, MOVE_ALONE = 0.62, 0.80
STEERING = (0.3, 0.2, 0.2, 0.3)


def hourly_rain(daily: DataFrame) -> DataFrame:
    """(.., hour, rain) of daily rain (.., day, rain): only hours with rain; NaN counts as none."""
    pattern = F.array(*[F.struct(F.lit(d).alias("pday"), F.lit(h).alias("hour"), F.lit(f).alias("share")) for d, h, f in HOURLY])
    rows = daily.select("*", F.inline(pattern)).where("pday = day")
    return rows.withColumn("rain", F.when(F.isnan("rain"), 0.0).otherwise(F.col("rain")) * F.col("share")).drop("pday", "share")


def above(value: Column, limit: float) -> Column:
    """value > limit with NaN and null false, as in IEEE comparison."""
    return F.coalesce(~F.isnan(value.cast("double")) & (value > limit), F.lit(False))


def can_start(sediment: Column, isotherm: Column, susceptibility: Column, sediment_min: float, susceptibility_min: float) -> Column:
    return above(sediment, sediment_min) & above(isotherm, 0.5) & above(susceptibility, susceptibility_min)


def _clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def velocity(law: str, v: Column, slope: Column, **p: float) -> Column:
    """The next velocity under one of the laws: copiapo (linear), coastal (quadratic drag), voellmy (Coulomb friction and turbulence)."""
    slowed = v * 0.95
    if law == "copiapo":
        faster = v + GRAVITY * slope * ((1 - p["friction"]) * p["factor"])
        return _clamp(F.when(slope > p["critical"], faster).otherwise(slowed), p["low"], p["high"])
    if law == "coastal":
        return F.when(slope <= 0, slowed).otherwise(_clamp(v + GRAVITY * slope - p["friction"] * v * v, 0.01, 600.0))
    if law == "voellmy":
        return F.when(slope <= 0, slowed).otherwise(_clamp(v + GRAVITY * (slope - p["mu"]) - GRAVITY * v * v / p["xi"], 0.01, 600.0))
    raise ValueError(f"unknown law {law}")


def volume(v: Column, first: Column, slope: Column, sediment: Column, erosion: float, entrain: float, bulking: float, on_slope: float, on_flat: float) -> Column:
    """Entrainment up to bulking times the first volume on erodible slopes, decay elsewhere."""
    grown = F.least(v * (1 + entrain * F.greatest(sediment, F.lit(0.0))), first * bulking)
    return F.when(slope > erosion, grown).otherwise(v * F.when(slope > 0.01, on_slope).otherwise(on_flat))


def activity(hour: Column, peak: float, amplitude: float, sigma: float, base: float) -> Column:
    """A circular Gaussian over the day, at most 1."""
    raw = F.abs(hour - peak)
    d = F.least(raw, 24 - raw)
    return F.least(base + amplitude * F.exp(-(d * d) / (2 * sigma * sigma)), F.lit(1.0))


# Fixed values of the rules below stand where they are used: 64 zones, 168 hours, 400 m, 1.8 times; the shares and limits of a kill; of flows, sheep, prey, dogs and hares.


def remembered(zones: Column, most: int = 64) -> Column:
    """The latest zones, as many as an animal remembers, of an array in the order of their steps."""
    return F.slice(zones, F.greatest(F.size(zones) - most + 1, F.lit(1)), most)


def avoids(risk: Column, chilla: Column, aversion: Column) -> Column:
    """Whether remembered risk, which a chilla feels 1.8 times, passes the animal's aversion."""
    return risk * F.when(chilla, 1.8).otherwise(1.0) > aversion


def zone_risk(zones: Column, x: Column, y: Column, now: Column, ttl: int = 168, radius: float = 400.0) -> Column:
    """Summed risk of remembered danger zones (px, py, step): fades with age and distance."""
    alive = F.filter(zones, lambda z: (now - z["step"]) < ttl)

    def one(z: Column) -> Column:
        dist = F.sqrt(F.pow(x - z["px"], F.lit(2)) + F.pow(y - z["py"], F.lit(2)))
        return F.when(dist < radius, (1 - (now - z["step"]) / float(ttl)) * (1 - dist / radius)).otherwise(0.0)

    return F.aggregate(F.transform(alive, one), F.lit(0.0).cast("double"), lambda a, r: a + r)


def kill_probability(efficiency: float, vulnerability: Column, cover: Column, dog: Column, group: Column, energy: Column, mother: Column) -> Column:
    """Efficiency times vulnerability, more in cover and for weak prey, less near a dog (null: none within 500), in a group and beside the mother (null: none)."""
    guarded = F.coalesce(-0.20 * (1 - dog / 500.0), F.lit(0.0))
    defended = F.when(mother < 20, -0.12 * (1 - mother / 20.0)).otherwise(0.0)
    p = efficiency * vulnerability + 0.05 * cover + guarded - 0.03 * F.least(group / 10.0, F.lit(1.0)) + 0.03 * (1 - energy / 100.0) + defended
    return _clamp(p, 0.02, 0.35)


def spread(flows: DataFrame, children: int, radius: float) -> DataFrame:
    """On flat ground a flow (idx, px, py, volume, velocity) sends children to a circle around it, each with an equal share of its volume and 0.8 of its velocity."""
    around = flows.select("*", F.explode(F.sequence(F.lit(0), F.lit(children - 1))).alias("child"))
    angle = F.col("child") * (2 * F.pi() / children)
    return around.select("idx", "child", (F.col("px") + radius * F.cos(angle)).alias("px"), (F.col("py") + radius * F.sin(angle)).alias("py"), (F.col("volume") / (children + 1)).alias("volume"), (F.col("velocity") * 0.8).alias("velocity"))


def flow_alive(volume: Column, velocity: Column, stuck: Column) -> tuple[Column, Column]:
    """(alive, velocity) of a flow: it dies when its volume is under 0.05; a stuck one slows by a tenth and dies under 0.01."""
    slowed = F.when(stuck, velocity * 0.9).otherwise(velocity)
    return ~(volume < 0.05) & ~(stuck & (slowed < 0.01)), slowed


def search_radii(velocity: Column) -> tuple[Column, Column]:
    """The window in which a flow looks for its next cell, and the wider one of its second try."""
    first = F.least(F.greatest(3 * F.floor(velocity).cast("int"), F.lit(2)), F.lit(10))
    return first, F.least(first + 5, F.lit(20))


def fan_radius(radius: Column, slope: Column, factor: float, threshold: float) -> Column:
    """The radius that a flow marks: wider by factor where the next cell is flatter than threshold."""
    return F.when((F.lit(factor) > 1.0) & above(-slope, -threshold), radius * factor).otherwise(radius)


def sheep_condition(fear: Column, age: Column, energy: Column, lamb: Column, quality: Column) -> dict[str, Column]:
    """fear, age, lamb and energy after an hour: fear fades, lambs older than 120 days are grown, grass feeds, fear costs."""
    calmer = F.greatest(fear - F.when(lamb, 0.05).otherwise(0.1), F.lit(0.0))
    older = age + 1 / 24.0
    fed = energy + F.when(lamb, quality).otherwise(quality * 2) - 1.0 - calmer * 2
    return {"fear": calmer, "age": older, "energy": F.least(fed, F.lit(100.0)), "lamb": lamb & ~(older > 120)}


def moves(word_uniform: Column, dog_near: Column) -> Column:
    """Whether the hour's activity is one that moves the animal."""
    return word_uniform < F.when(dog_near, MOVE_NEAR_DOG).otherwise(MOVE_ALONE)


def pulled(food: tuple[Column, Column], risk: tuple[Column, Column], cohesion: tuple[Column, Column], dog: tuple[Column, Column], noise: tuple[Column, Column]) -> tuple[Column, Column]:
    """The weighted pulls, added up in this order, and some noise."""
    parts = [[w * pull[i] for w, pull in zip(STEERING, (food, risk, cohesion, dog), strict=True)] + [noise[i]] for i in (0, 1)]
    return tuple(sum(p[1:], p[0]) for p in parts)


def heading(food: tuple[Column, Column], risk: tuple[Column, Column], cohesion: tuple[Column, Column], dog: tuple[Column, Column], noise: tuple[Column, Column]) -> tuple[Column, Column]:
    """The unit vector of what pulls; zero where that cancels."""
    x, y = pulled(food, risk, cohesion, dog, noise)
    n = F.sqrt(x * x + y * y)
    return F.when(n > 0, x / n).otherwise(0.0), F.when(n > 0, y / n).otherwise(0.0)


def choose_prey(foxes: DataFrame, herd: DataFrame, spec: SpaceSpec, radius: float) -> DataFrame:
    """(fox, prey, score) for foxes (fox, px, py) that see any of herd (prey, px, py, kind, lamb, vulnerability) within radius: the most vulnerable, sheep 0.3 less with two hares or more
    about, lambs 0.2 more; ties go to the smallest prey.

    All scores that prey can have, sheep two of them, are put in one order, so that places meet places by their best numbers and not each fox all prey.
    """
    sheep, scored = F.col("kind") == "sheep", lambda less: F.col("vulnerability") - F.lit(less) + F.when(F.col("lamb"), 0.2).otherwise(0.0)
    shy = F.when(sheep, F.array(F.struct(F.lit(False).alias("many"), scored(0.0).alias("score")), F.struct(F.lit(True).alias("many"), scored(0.3).alias("score"))))
    rows = herd.select("*", F.explode(F.coalesce(shy, F.array(F.struct(F.lit(None).cast("boolean").alias("many"), scored(0.0).alias("score"))))).alias("__s")).select("*", "__s.*").drop("__s")
    rows = settled(ranks.numbered_within(rows, [], [F.col("score").desc(), F.col("prey")], "place"))
    least = lambda many: F.min(F.when(F.col("many").eqNullSafe(F.lit(many).cast("boolean")), F.col("place")))
    there = rows.groupBy("px", "py").agg(F.count_if(F.col("kind") == "hare").alias("hares"), least(None).alias("other"), least(False).alias("few"), least(True).alias("many"))
    at = foxes.groupBy("px", "py").agg(F.min("fox").alias("one"))
    best = F.least(F.min("q_other"), F.when(F.sum("q_hares") >= 2, F.min("q_many")).otherwise(F.min("q_few")))
    seen = radius_join(at, there, spec, radius).groupBy("px", "py").agg(best.alias("place"))
    chosen = seen.join(rows.select("place", "prey", "score").hint("merge"), "place")
    return foxes.select("fox", "px", "py").join(chosen.hint("merge"), ["px", "py"]).select("fox", "prey", "score")


def attack(prey_distance: Column, dog_distance: Column, stalked: Column) -> Column:
    """strike, stalk or none for prey within 50: with a dog within 1200 the hunter lies in wait for an hour and strikes the next."""
    near = prey_distance < 50
    return F.when(near & (stalked | ~F.coalesce(dog_distance < 1200, F.lit(False))), "strike").when(near, "stalk").otherwise("none")


def deterred(contacts: DataFrame, foxes: DataFrame, spec: SpaceSpec, radius: float = 200.0) -> DataFrame:
    """(fox, n): foxes that see a dog at contact (idx, px, py: the dogs in contact) within radius, and by how many. The one in contact is among them."""
    return within(foxes, contacts, spec, radius).select(F.col("idx").alias("fox"), "n")


def patrol(dogs: DataFrame, flock: DataFrame, radius: float = 250.0, speed: float = 300.0) -> DataFrame:
    """(idx, px, py, angle): dogs (idx, px, py, angle) head for their place on a circle round the flock's middle, an angle of 0.1 on."""
    middle = flock.agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    out = dogs.crossJoin(F.broadcast(middle)).withColumn("angle", F.col("angle") + 0.1)
    dx = F.col("cx") + radius * F.cos("angle") - F.col("px")
    dy = F.col("cy") + radius * F.sin("angle") - F.col("py")
    n = F.sqrt(dx * dx + dy * dy)
    go = lambda c, d: F.col(c) + F.when(n > 0, d / n * speed).otherwise(0.0)
    return out.select("idx", go("px", dx).alias("px"), go("py", dy).alias("py"), "angle")


def flee(hares: DataFrame, foxes: DataFrame, spec: SpaceSpec, radius: float = 80.0, speed: float = 800.0) -> DataFrame:
    """(idx, px, py, fled): hares run straight away from the nearest fox within radius, others stay; places are kept inside the space."""
    near = found_nearest(hares, foxes, spec, 1, radius).select("idx", F.get("found", 0).alias("b"))
    out = hares.join(near.hint("merge"), "idx", "left")
    away = lambda c: F.when(F.col("b.dist") > 0, (F.col(f"p{c}") - F.col(f"b.q_p{c}")) / F.col("b.dist") * speed).otherwise(0.0)
    nx, ny = wrap(spec, F.col("px") + F.coalesce(away("x"), F.lit(0.0)), F.col("py") + F.coalesce(away("y"), F.lit(0.0)))
    return out.select("idx", nx.alias("px"), ny.alias("py"), F.col("b").isNotNull().alias("fled"))


def hare_step(hares: DataFrame, foxes: DataFrame, ways: DataFrame, angle: Column, spec: SpaceSpec, radius: float = 80.0, run: float = 800.0, walk: float = 120.0, calm: float = 0.15, scared: float = 0.5) -> DataFrame:
    """(idx, px, py, fear, did) of hares (idx, px, py, fear): those with a fox within radius flee straight from it, those whose fear, less calm, is over scared run along angle, the others walk
    along their way (idx, ox, oy) to better food, or stay where there is none."""
    gone = flee(hares.select("idx", "px", "py"), foxes, spec, radius, run).select("idx", F.col("px").alias("fx"), F.col("py").alias("fy"), "fled")
    out = hares.join(gone, "idx").join(ways, "idx", "left").withColumn("fear", F.greatest(F.col("fear") - calm, F.lit(0.0)))
    did = F.when(F.col("fled"), "flee").when(F.col("fear") > scared, "panic").otherwise("forage")
    out = out.withColumn("did", did)
    go = lambda o, a: F.when(F.col("did") == "panic", run * a).otherwise(walk * F.coalesce(o, F.lit(0.0)))
    nx, ny = wrap(spec, F.col("px") + go(F.col("ox"), F.cos(angle)), F.col("py") + go(F.col("oy"), F.sin(angle)))
    kept = lambda a, b: F.when(F.col("did") == "flee", F.col(a)).otherwise(b)
    return out.select("idx", kept("fx", nx).alias("px"), kept("fy", ny).alias("py"), "fear", "did")
