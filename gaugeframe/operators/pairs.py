"""Matched pairs of a valid root and a violating counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs with both sides' ids; several counters may share one positive, a side may be missing."""
    keys = keys or []
    roots = rows.filter("kind <> 'variant'")
    counter = roots.filter("kind = 'counter'").select(*keys, F.col("item_id").alias("negative_id"), F.col("positive_id").alias("_p"), F.coalesce("pair_id", "item_id").alias("_pair"))
    explicit = roots.filter("kind = 'root' and pair_id is not null").select(*keys, F.col("item_id").alias("_e"), F.col("pair_id").alias("_pair"))
    both = counter.join(explicit, [*keys, "_pair"], "full_outer")
    return both.select(*keys, F.col("_pair").alias("pair_id"), F.coalesce("_p", "_e").alias("positive_id"), "negative_id")


def measure(pairs: DataFrame, rows: DataFrame, radii: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Complete, eligible pairs with both radii: scores, gap and radii of each side."""
    keys = keys or []
    side = lambda name: rows.filter("kind <> 'variant' and eligible").select(*keys, F.col("item_id").alias(f"{name}_id"), F.col("score").alias(f"{name}_score"), *([F.col("unit_id")] if name == "positive" else []))
    radius = lambda name: radii.select(*keys, F.col("item_id").alias(f"{name}_id"), F.col("radius").alias(f"{name}_radius"))
    out = pairs
    for name in ("positive", "negative"):
        out = out.join(side(name), [*keys, f"{name}_id"]).join(radius(name), [*keys, f"{name}_id"])
    return out.withColumn("gap", F.col("positive_score") - F.col("negative_score"))


def summarise(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Row and unit rates of sensitivity and certification, effect size, and sign counts."""
    ordered, separated = F.col("gap") > 0, F.col("gap") > F.col("positive_radius") + F.col("negative_radius")
    per = pairs.groupBy(*keys, "unit_id").agg(F.avg(ordered.cast("double")).alias("_s"), F.avg(separated.cast("double")).alias("_c"))
    rates = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg(ordered.cast("double")).alias("sensitivity"), F.avg(separated.cast("double")).alias("separated"), F.avg("gap").alias("mean_gap"))
    unit = per.groupBy(*keys).agg(F.avg("_s").alias("unit_sensitivity"), F.avg("_c").alias("unit_separated"))
    return rates.join(unit, keys) if keys else rates.crossJoin(unit)
