"""Long-form metric rows and summaries over finite values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalars import finite


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value); booleans and non-numbers are left to the caller."""
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def finite_summary(long: DataFrame, keys: list[str], value: str = "value", label: str | None = None) -> DataFrame:
    """Mean, sample deviation (0 for fewer than two), min, max and count over finite values; NaN
    means where none is finite; distinct labels joined in order."""
    v = F.when(finite(F.col(value)), F.col(value))
    labels = [F.array_join(F.sort_array(F.collect_set(label)), "|").alias("labels")] if label else []
    nan = F.lit(float("nan"))
    return long.groupBy(*keys).agg(F.coalesce(F.avg(v), nan).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"), *labels)


def label_counts(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(column, value, n) of the label class and of each split column, in one pass."""
    value = F.coalesce(F.col(label).cast("string"), F.lit("unlabelled"))
    entries = F.array(F.struct(F.lit(label).alias("column"), value.alias("value")), *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("e")).groupBy("e.column", "e.value").agg(F.count("*").alias("n")).select("column", "value", "n")


def score_families(df: DataFrame, scores: str) -> DataFrame:
    """Names present in every row's score map, with their family: fixed names, or the last part of
    layer_<n>.<metric> and layers_mean.<metric>."""
    total = df.agg(F.count("*").alias("_rows"))
    names = df.select(F.explode(F.map_keys(scores)).alias("name")).groupBy("name").agg(F.count("*").alias("_n"))
    common = names.crossJoin(F.broadcast(total)).filter("_n = _rows")
    layered = F.regexp_extract("name", r"^(?:layer_\d+|layers_mean)\.(.+)$", 1)
    return common.select(F.when(layered != "", layered).otherwise(F.col("name")).alias("family"), "name")


def selection_bound(n, m, delta: float):
    """sqrt(ln(2m/delta) / (2n))."""
    return F.sqrt(F.log(2.0 * m / F.lit(delta)) / (2.0 * n))
