"""Exact tails, effect sizes, bootstrap and permutation tests; all draws are hashes of (seed,
replicate, slot), so they are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import hex_to_long
from gaugeframe.operators.prefix import on, once
from gaugeframe.operators.rankstats import auroc


def binomial_tail(k: Column, n: Column) -> Column:
    """min(1, 2 * sum_{i<=k} C(n,i) / 2^n), from running logarithms, so large n does not overflow."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    n_ = n.cast("double")

    def step(acc: Column, i: Column) -> Column:
        c = F.when(i == 0, F.lit(0.0)).otherwise(acc["c"] + F.log((n_ - i + 1) / i))
        return F.struct(c.alias("c"), (acc["s"] + F.exp(c - n_ * F.log(F.lit(2.0)))).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, step)["s"]
    return F.least(F.lit(1.0), tail * 2)


def sign_test(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two-sided exact sign test; zeros are dropped; NaN if none is left."""
    counts = df.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("n_pos"), F.count_if(F.col(value) < 0).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return counts.withColumn("p_value", F.when(n > 0, binomial_tail(F.least("n_pos", "n_neg"), n)).otherwise(F.lit(float("nan"))))


def effect_size(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and standardised mean: over the sample deviation, or the root mean square where that
    vanishes (zero where that vanishes too); one value gives its absolute value."""
    agg = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_rms"))
    eps = 2.220446049250313e-16
    scale = F.when(F.col("n") == 1, F.abs("mean")).otherwise(F.col("_sd"))
    scale = F.when(scale > eps, scale).otherwise(F.col("_rms"))
    return agg.select(*keys, "n", "mean", F.when(scale > eps, F.col("mean") / scale).otherwise(F.lit(0.0)).alias("effect"))


def mcnemar(df: DataFrame, keys: list[str], label: str, first: str, second: str) -> DataFrame:
    a, b = F.col(first) == F.col(label), F.col(second) == F.col(label)
    counts = df.groupBy(*keys).agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))
    n = F.col("only_first") + F.col("only_second")
    return counts.withColumn("p_value", F.when(n > 0, binomial_tail(F.least("only_first", "only_second"), n)).otherwise(F.lit(1.0)))


def _draws(groups: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """(rep, unit, times): how often each replicate draws each unit, with replacement.

    Slots are hashed to ranks; equal draws are counted before they meet the units, so a replicate
    ships one row per distinct unit drawn.
    """
    spark = groups.sparkSession
    placed = once(groups.select(unit).distinct().orderBy(unit).select(unit, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    # places in order without one window over all units: partitions follow one another
    parts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    parts = parts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    ranked = placed.join(F.broadcast(parts), "_p").select(unit, (F.col("_o") + F.col("_m") - F.col("_first")).alias("_i"))
    n = max(1, placed.count())
    slots = spark.range(replicates * n).select(F.expr(f"id div {n}").alias("rep"), (F.col("id") % n).alias("slot"))
    pick = hex_to_long(F.sha2(F.concat_ws(":", F.lit(seed), F.col("rep"), F.col("slot")).cast("binary"), 256)) % n
    drawn = slots.select("rep", pick.alias("_i")).groupBy("rep", "_i").agg(F.count("*").alias("times"))
    return drawn.join(ranked, "_i").select("rep", unit, "times")


def bootstrap_mean(df: DataFrame, unit: str, value: str, replicates: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the mean under resampling of whole units."""
    sums = df.groupBy(unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    stats = _draws(sums, unit, replicates, seed).join(sums, unit).groupBy("rep").agg((F.sum(F.col("_s") * F.col("times")) / F.sum(F.col("_c") * F.col("times"))).alias("stat"))
    tail = (1 - confidence) / 2
    point = df.agg(F.avg(value).alias("estimate"))
    return stats.agg(F.percentile("stat", F.lit(tail)).alias("low"), F.percentile("stat", F.lit(1 - tail)).alias("high"), F.count("*").alias("replicates")).crossJoin(F.broadcast(point))


def bootstrap_auc_difference(df: DataFrame, unit: str, label: str, first: str, second: str, replicates: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Interval of AUROC(first) - AUROC(second); replicates with one class are skipped and counted."""
    rows = df.join(_draws(df, unit, replicates, seed), unit)
    long = rows.select("rep", label, "times", F.expr(f"stack(2, 1, cast({first} as double), 2, cast({second} as double)) as (which, score)"))
    both = auroc(long, ["rep", "which"], "score", label, F.col("times"), wide=False)
    diff = both.groupBy("rep").agg(F.sum(F.when(F.col("which") == 1, F.col("auroc")).otherwise(-F.col("auroc"))).alias("d"))
    ok = F.when(~F.isnan("d"), F.col("d"))
    tail = (1 - confidence) / 2
    return diff.agg(F.percentile(ok, F.lit(tail)).alias("low"), F.percentile(ok, F.lit(1 - tail)).alias("high"), F.count(ok).alias("used"), F.count_if(F.isnan("d")).alias("skipped"))


def permutation_exact(df: DataFrame, difference: str, tie: str) -> DataFrame:
    """Two-sided sign-flip test by all 2^n sign patterns; for up to 18 pairs, more are refused
    (``permutation_sampled`` takes any number)."""
    if len(df.limit(19).collect()) > 18:
        raise ValueError("more than 18 pairs")
    line = df.agg(F.array_sort(F.collect_list(F.struct(tie, difference))).alias("_x")).select(F.transform("_x", lambda e: e[difference]).alias("d"), F.size("_x").alias("n"))
    observed = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    signs = line.withColumn("observed", observed).withColumn("mask", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("shiftleft(1L, n) - 1"))))
    flipped = F.aggregate(F.transform("d", lambda x, i: F.when(F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) > 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    slack = 8 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs("observed"))
    return signs.withColumn("m", flipped).groupBy("n", "observed").agg(F.avg((F.abs("m") >= F.abs("observed") - slack).cast("double")).alias("p_value"), F.count("*").alias("patterns"))


def permutation_sampled(df: DataFrame, key: str, difference: str, replicates: int, seed: int) -> DataFrame:
    """Sign-flip test by hashed signs with the plus-one rule."""
    obs = df.agg(F.avg(difference).alias("observed"))
    reps = df.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    signs = df.select(key, difference).crossJoin(F.broadcast(reps))  # replicates x pairs, by design
    bit = hex_to_long(F.sha2(F.concat_ws(":", F.lit(seed), F.col("rep"), F.col(key)).cast("binary"), 256), 8) % 2
    means = signs.groupBy("rep").agg(F.avg(F.when(bit == 1, -F.col(difference)).otherwise(F.col(difference))).alias("m"))
    joined = on([], means, obs)
    slack = 8 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs("observed"))
    hits = F.count_if(F.abs("m") >= F.abs("observed") - slack)
    return joined.groupBy("observed").agg(((hits + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("replicates"))
