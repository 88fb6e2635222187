"""Sweeps over score files, families and seeds: all of them are keys of one plan.

Every function takes long rows with the sweep's dimensions as columns; nothing loops over files. The
one loop left is over settings of an ablation (a few), whose results are stacked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.scalars import finite
from gaugeframe.operators import filters, report
from gaugeframe.plans import protocol

#: Status words of result rows, and the metrics that an ablation reports.
FROZEN, NOT_APPLICABLE, ORACLE = "frozen_result_from_local_inference", "not_applicable", "diagnostic_oracle_full_data_do_not_compare"
CORE = ("auroc", "balanced_accuracy", "flip_rate", "sensitivity", "certified", "abstention")


def with_probe(rows: DataFrame, probe: DataFrame, name: str = "linear_probe") -> DataFrame:
    """Score rows (item_id, candidate, score, ...) and, as one more candidate, the probe's logit."""
    own = rows.drop("candidate", "score").distinct().join(probe.select("item_id", F.col("logit").alias("score")), "item_id")
    return rows.unionByName(own.withColumn("candidate", F.lit(name)).select(*rows.columns))


def core_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of the headline metrics."""
    return report.unpivot(metrics, keys, list(CORE))


def evaluate(rows: DataFrame, keys: list[str], seeds: tuple[int, ...], alpha: float = 0.1, size: int | None = None, excluded: DataFrame | None = None, source: str | None = None) -> dict[str, DataFrame]:
    """metrics (keys, seed, metric, value), items (decisions of test roots), summary over seeds, and,
    with ``excluded`` units, the dropped rows per ``source``."""
    out: dict[str, DataFrame] = {}
    if excluded is not None:
        rows, out["exclusions"] = filters.exclude_units(rows, excluded, "unit_id", source)
    metrics, items = [], []
    for seed in seeds:
        split, state, found = protocol.run(rows, seed, alpha, size, keys)
        metrics.append(found.withColumn("seed", F.lit(seed)))
        items.append(protocol.judged(rows, split, state, keys).withColumn("seed", F.lit(seed)))
    out["metrics"] = core_metrics(reduce(DataFrame.unionByName, metrics), [*keys, "seed"])
    out["items"] = reduce(DataFrame.unionByName, items)
    out["summary"] = sweep_summary(out["metrics"], [*keys, "metric"])
    return out


def sweep_summary(long: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """Mean, deviation, range and count of finite values over seeds; the interval stays empty, as
    seeds share their examples and are no independent repetitions."""
    nan = F.lit(float("nan"))
    return report.finite_summary(long, keys, label=label).withColumn("ci95_lower", nan).withColumn("ci95_upper", nan)


def ablation(rows: DataFrame, keys: list[str], condition: str, setting: str, seed: int, alpha: float = 0.1, size: int | None = None, applicable: Column | None = None) -> DataFrame:
    """Core metrics of one setting as (keys, condition, setting, seed, status, metric, value,
    reason): keys whose pool is too small for the setting give one not-applicable row each.

    ``applicable`` is an aggregate over a key's rows; by default, that both sides of the split's
    calibration part hold ``size`` units.
    """
    split, _, metrics = protocol.run(rows, seed, alpha, size, keys)
    pool = rows.join(split.filter("split = 'calibration'"), "unit_id").filter("kind <> 'variant' and eligible")
    enough = applicable if applicable is not None else F.least(F.count_distinct(F.when(F.col("label") == 1, F.col("unit_id"))), F.count_distinct(F.when(F.col("label") == 0, F.col("unit_id")))) >= F.lit(size or 1)
    judged = pool.groupBy(*keys).agg(enough.alias("_ok"))
    names = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    state = names.join(judged, keys, "left") if keys else judged
    state = state.withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    good = metrics.join(state.filter("_ok").select(*keys), keys, "left_semi") if keys else metrics.join(F.broadcast(state.filter("_ok").select("_ok")), F.lit(True), "left_semi")
    fixed = [F.lit(condition).alias("condition"), F.lit(setting).alias("setting"), F.lit(seed).alias("seed")]
    done = core_metrics(good, keys).select(*keys, *fixed, F.lit(FROZEN).alias("status"), "metric", "value", F.lit(None).cast("string").alias("reason"))
    bad = state.filter("not _ok").select(*keys, *fixed, F.lit(NOT_APPLICABLE).alias("status"), F.lit(NOT_APPLICABLE).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("calibration pool too small").alias("reason"))
    return done.unionByName(bad)


def ablation_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of frozen rows; rows of any other status pass as they are (n is null there)."""
    frozen = report.finite_summary(rows.filter(F.col("status") == FROZEN), [*keys, "condition", "setting", "metric"])
    frozen = frozen.select(*keys, "condition", "setting", "metric", F.lit(FROZEN).alias("status"), F.col("mean").alias("value"), "std", "min", "max", "n", F.lit(None).cast("string").alias("reason"))
    other = rows.filter(F.col("status") != FROZEN).select(*keys, "condition", "setting", "metric", "status", "value", "reason")
    return frozen.unionByName(other, allowMissingColumns=True)


def full_data_oracle(rows: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """Per key the candidate of best (AUROC, balanced accuracy, name) when orientation and threshold
    are chosen on all data; a diagnostic that is marked as such."""
    by = [*keys, candidate]
    cells = protocol.cells(rows, by)
    turned = protocol.orientation(cells, by)
    oriented = cells.join(turned, by).withColumn("score", F.col("score") * F.col("orientation"))
    cut = protocol.threshold_argmax(oriented, by, "score", "label")
    both = turned.join(cut, by).select(*by, F.col("train_auroc").alias("auroc"), "balanced_accuracy").filter(finite(F.col("auroc")))
    best = both.groupBy(*keys).agg(F.max(F.struct("auroc", "balanced_accuracy", candidate)).alias("_b")).select(*keys, "_b.*")
    return best.withColumn("status", F.lit(ORACLE))
