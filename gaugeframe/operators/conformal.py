"""Stability radii, conformal quantiles, certificates and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.prefix import on, once, running

INF = float("inf")


def root_radii(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per root the largest absolute score change over its eligible variants; roots without any are
    absent. Columns: keys, item_id, unit_id, label, score, radius."""
    keys = keys or []
    child = rows.filter("kind = 'variant' and eligible").select(*keys, F.col("parent_id").alias("item_id"), F.col("score").alias("_s"))
    roots = rows.filter("kind <> 'variant'").select(*keys, "item_id", "unit_id", "label", "kind", "eligible", "score")
    joined = roots.join(child, [*keys, "item_id"])
    return joined.groupBy(*keys, "item_id", "unit_id", "label", "kind", "eligible", "score").agg(F.max(F.abs(F.col("_s") - F.col("score"))).alias("radius"))


def array_radius(base: Column, transformed: Column) -> Column:
    """Largest absolute change over an array of transformed scores."""
    return F.array_max(F.transform(transformed, lambda t: F.abs(t - base)))


def unit_radii(radii: DataFrame, keys: list[str]) -> DataFrame:
    return radii.groupBy(*keys, "unit_id").agg(F.max("radius").alias("radius"), F.count("*").alias("n_roots"))


def side(label: Column) -> Column:
    return F.when(label == 1, F.lit("positive")).otherwise(F.lit("negative"))


def quantile(df: DataFrame, keys: list[str], radius: str, alpha: float | Column, wide: bool = True) -> DataFrame:
    """keys, n, k, q: the k-th smallest radius with k = ceil((n+1)(1-alpha)); infinite if k > n.

    The order statistic comes from counts by value and their running sum, not from a sorted list.
    """
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    counts = df.groupBy(*keys, radius).agg(F.count("*").alias("_c"))
    counts = once(counts) if wide else counts
    upto = running(counts, keys, radius, {"_upto": "_c"}, wide=wide)
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("n")).withColumn("k", F.ceil((F.col("n") + 1) * (F.lit(1.0) - a)).cast("bigint"))
    found = on(keys, upto, n).filter("_upto >= k").groupBy(*keys).agg(F.min(radius).alias("_q"))
    joined = n.join(found, keys, "left") if keys else n.join(F.broadcast(found), F.lit(True), "left")
    return joined.select(*keys, "n", "k", F.when(F.col("k") > F.col("n"), F.lit(INF)).otherwise(F.col("_q")).alias("q"))


def interval(score: Column, q: Column) -> tuple[Column, Column]:
    return score - q, score + q


def decision(score: Column, threshold: Column, q: Column) -> Column:
    """valid above, invalid below, abstain where the interval touches or holds the threshold."""
    low, high = interval(score, q)
    return F.when(low > threshold, "valid").when(high < threshold, "invalid").otherwise("abstain")


def covered(base: Column, transformed: Column, q: Column) -> Column:
    return F.abs(transformed - base) <= q


def group_mean(df: DataFrame, keys: list[str], unit: str, flags: dict[str, Column]) -> DataFrame:
    """Mean over units of each unit's mean flag."""
    per = df.groupBy(*keys, unit).agg(*[F.avg(f.cast("double")).alias(n) for n, f in flags.items()])
    return per.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in flags])
