"""Evaluation and statistics of runs as aggregations and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentframe.operators import ranks


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """(by, tp, fp, fn, truth_n) of boolean truth and pred."""
    t, p = F.col("truth"), F.col("pred")
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("truth_n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame, cell_km2: float = 0.0009) -> DataFrame:
    """iou, precision, recall, f1 and areas of confusion counts; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"iou": _ratio(tp, tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumns({"f1": f1, "pred_km2": (tp + fp) * cell_km2, "truth_km2": (tp + fn) * cell_km2})


def pad_locf(runs: DataFrame, keys: list[str], value: str, horizon: int) -> DataFrame:
    """Each run (keys) on every step from 0 to horizon, its last value carried forward."""
    steps = runs.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(horizon).cast("long"))))
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(runs.select(*keys, "step", value), [*keys, "step"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def z_test(df: DataFrame, group: str, a, b, value: str, *by: str) -> DataFrame:
    """(by, z, pass) of the means of two groups with sample variances; z is 0 for no spread."""
    at = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.groupBy(*by).agg(F.avg(at(a)).alias("ma"), F.avg(at(b)).alias("mb"), F.var_samp(at(a)).alias("va"), F.var_samp(at(b)).alias("vb"), F.count(at(a)).alias("na"), F.count(at(b)).alias("nb"))
    se = F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    z = F.when(se > 0, (F.col("ma") - F.col("mb")) / se).otherwise(0.0)
    return s.select(*by, z.alias("z"), (F.abs(z) < 1.96).alias("pass"))


def tie_ranks(df: DataFrame, by: list[str], value: Column, name: str = "rank") -> DataFrame:
    """df with ranks of value, ties sharing their mean rank. For groups of a bounded number of rows, as the methods of a block; ranks.mean_ranks takes groups of any size."""
    df = df.withColumn("__v", value)
    first = F.rank().over(Window.partitionBy(*by).orderBy("__v"))
    ties = F.count("*").over(Window.partitionBy(*by, "__v"))
    return df.withColumn(name, first + (ties - 1) / 2.0).drop("__v")


def friedman(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """(chi2, n, k) of blocks x methods, without tie correction."""
    ranked = tie_ranks(df, [block], F.col(value))
    sums = ranked.groupBy(method).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    s = sums.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max("n").alias("n"), F.count("*").alias("k"))
    chi2 = 12.0 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("rr") - 3.0 * F.col("n") * (F.col("k") + 1)
    return s.select(chi2.alias("chi2"), "n", "k")


def log_gamma_half(twice: Column) -> Column:
    """log of the gamma function at half of a positive integer."""
    steps = F.sequence(F.lit(1), F.greatest(F.floor((twice - 1) / 2), F.lit(1)).cast("int"))
    odd = twice % 2 == 1
    logs = F.transform(steps, lambda i: F.when(i <= F.floor((twice - 1) / 2), F.log(F.when(odd, i - 0.5).otherwise(i.cast("double")))).otherwise(0.0))
    return F.aggregate(logs, F.when(odd, 0.5 * math.log(math.pi)).otherwise(0.0).cast("double"), lambda a, t: a + t)


def chi2_tail(x: Column, d: Column, terms: int = 400) -> Column:
    """The chance of a chi-square variable of d degrees of freedom above x: a fixed number of terms of the series below the mean, of the continued fraction above it."""
    a, h = d / 2.0, x / 2.0
    scale = F.exp(-h + a * F.log(h) - log_gamma_half(d.cast("int")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda z, k: F.struct((z["t"] * h / (a + k)).alias("t"), (z["s"] + z["t"] * h / (a + k)).alias("s")), lambda z: z["s"])
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), (h + 2 * terms + 1 - a), lambda t, i: h + 2 * i - 1 - a - i * (i - a) / t)
    return F.when(x <= 0, 1.0).when(h < a + 1, 1 - scale * series).otherwise(scale / fraction)


def friedman_p(chi2: Column, methods: Column) -> Column:
    """The chance of a Friedman statistic as great, for any number of methods."""
    return F.when(methods > 1, chi2_tail(chi2, methods - 1))


def signed_rank_table(spark: SparkSession, most: int) -> DataFrame:
    """(n, chances): for n differences without ties, up to most, the chance of each smaller rank sum 0, 1, 2, ... or less. A row an n; counts stay whole up to n = 53."""
    if not 1 <= most <= 53:
        raise ValueError("exact chances are there for 1 to 53 differences")
    sums = F.sequence(F.lit(0), (F.col("n") * (F.col("n") + 1) / 2).cast("int"))
    first = F.transform(sums, lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), first, lambda w, r: F.transform(w, lambda v, s: v + F.when(s >= r, F.get(w, s - r)).otherwise(0.0)))
    upto = F.aggregate("ways", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all")), lambda z, v: F.struct((z["s"] + v).alias("s"), F.concat(z["all"], F.array((z["s"] + v) / F.pow(F.lit(2.0), F.col("n")))).alias("all")), lambda z: z["all"])
    return spark.range(1, most + 1).withColumnRenamed("id", "n").withColumn("ways", ways).select("n", upto.alias("chances"))


def with_wilcoxon_p(tests: DataFrame, exact_up_to: int = 25) -> DataFrame:
    """tests (w, n, tied, ...) with p: exact for as many differences without ties, by the normal approximation beyond; 1 without differences."""
    table = F.broadcast(signed_rank_table(tests.sparkSession, exact_up_to))
    exact = F.least(F.lit(1.0), 2 * F.get("chances", F.floor("w").cast("int")))
    return tests.join(table, "n", "left").withColumn("p", F.when(F.col("chances").isNotNull() & ~F.col("tied"), exact).otherwise(wilcoxon_p(F.col("w"), F.col("n")))).drop("chances")


def wilcoxon_p(w: Column, n: Column) -> Column:
    """Two-sided chance of a smaller rank sum by the normal approximation with continuity correction, as the usual tables do for n over 25."""
    mean, sd = n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    z = F.greatest((mean - w - 0.5) / sd, F.lit(0.0))
    # The coefficients of a published rational approximation of the normal tail, good to 7.5e-8.
    t = 1 / (1 + 0.2316419 * z)
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * tail)


def wilcoxon(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """(a, b, w, n, tied) of each pair of methods: the smaller signed-rank sum over non-zero differences. A pair's blocks are ranked over range partitions."""
    left = df.select(block, F.col(method).alias("a"), F.col(value).alias("va"))
    right = df.select(block, F.col(method).alias("b"), F.col(value).alias("vb"))
    diff = left.join(right, block).where("a < b").withColumn("d", F.col("va") - F.col("vb")).where("d <> 0")
    ranked = ranks.mean_ranks(diff, ["a", "b"], F.abs("d"))
    return ranked.groupBy("a", "b").agg(F.least(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0))).alias("w"), F.count("*").alias("n"), (F.count("*") > F.countDistinct(F.abs("d"))).alias("tied"))


def holm(df: DataFrame, p: str, *order: str) -> DataFrame:
    """df with Holm's step-down adjusted p; ties are put in order by the further columns. The tests of one study are a handful of rows."""
    everything = Window.partitionBy(F.lit(1))
    w = everything.orderBy(p, *order)
    scaled = df.withColumn("__s", F.least(F.lit(1.0), (F.count("*").over(everything) - F.row_number().over(w) + 1) * F.col(p)))
    return scaled.withColumn("adjusted", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def parity(df: DataFrame, a: str, b: str, by: list[str], *order: str) -> DataFrame:
    """(by, pearson, spearman of ordinal ranks, rmse, mae, bias) of two columns; groups of any size are ranked over range partitions."""
    d = F.col(a) - F.col(b)
    ranked = df
    for c, name in ((a, "__ra"), (b, "__rb")):
        ranked = ranks.numbered_within(ranked, by, [F.col(x) for x in (c, *order)], name)
    return ranked.groupBy(*by).agg(F.corr(a, b).alias("pearson"), F.corr("__ra", "__rb").alias("spearman"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))


def roc(df: DataFrame, score: str, truth: str, bins: int = 200) -> DataFrame:
    """(threshold, tpr, fpr) at the edges of equal bins of a score in [0, 1]: counts per bin first, so the window runs over bins, not rows."""
    edge = F.floor(F.least(F.col(score), F.lit(1.0)) * bins).cast("int")
    counts = df.groupBy(edge.alias("bin")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("q"))
    w = Window.partitionBy(F.lit(1))
    down = w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select((F.col("bin") / float(bins)).alias("threshold"), _ratio(F.sum("p").over(down), F.sum("p").over(w)).alias("tpr"), _ratio(F.sum("q").over(down), F.sum("q").over(w)).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """(auc, best): the trapezoid area of a roc curve from (0, 0), and the threshold with the greatest tpr - fpr."""
    w = Window.partitionBy(F.lit(1)).orderBy("fpr", "tpr")
    piece = (F.col("fpr") - F.coalesce(F.lag("fpr").over(w), F.lit(0.0))) * (F.col("tpr") + F.coalesce(F.lag("tpr").over(w), F.lit(0.0))) / 2
    best = F.max_by("threshold", F.struct(F.round(F.col("tpr") - F.col("fpr"), 9), "threshold"))
    return curve.withColumn("piece", piece).agg(F.sum("piece").alias("auc"), best.alias("best"))
