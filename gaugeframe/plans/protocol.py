"""The frozen protocol as one lazy plan: fit on train, calibrate, freeze, judge the test split.

``keys`` are sweep dimensions (score name, family, seed, ...): all of them are fitted and judged in
the same plan. Nothing is collected; the frozen state is a small table joined to the test rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import stable_hex
from gaugeframe.operators import conformal, pairs
from gaugeframe.operators.prefix import hash_rank, on, once, spread
from gaugeframe.operators.rankstats import auroc, average_precision, binary_suite, threshold_argmax
from gaugeframe.operators.splits import exact_split


def analysis_roots(rows: DataFrame) -> DataFrame:
    return rows.filter("kind <> 'variant' and (kind <> 'counter' or eligible)")


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One equally weighted mean per unit and label; to nine decimals, so that ties do not depend on
    the order of summation."""
    return analysis_roots(rows).groupBy(*keys, "unit_id", "label").agg(F.round(F.avg("score"), 9).alias("score"))


def orientation(train: DataFrame, keys: list[str], wide: bool = True) -> DataFrame:
    """-1 only where the negated score ranks strictly better; its AUROC is one minus the other."""
    found = auroc(train, keys, "score", "label", wide=wide)
    flip = F.col("auroc") < 0.5
    return found.select(*keys, F.when(flip, -1).otherwise(1).alias("orientation"), F.when(flip, 1 - F.col("auroc")).otherwise(F.col("auroc")).alias("train_auroc"))


def calibration_radii(rows: DataFrame, keys: list[str], size: int | None, seed: int, namespace: str = "calibration-subsample", wide: bool = True) -> DataFrame:
    """Largest radius per unit and side; with ``size`` the first units of each side in hash order."""
    radii = conformal.root_radii(rows, keys).withColumn("side", conformal.side(F.col("label")))
    per = radii.groupBy(*keys, "side", "unit_id").agg(F.max("radius").alias("radius"))
    if size is None:
        return per
    ranked = hash_rank(per.withColumn("_h", F.concat(F.substring(stable_hex(namespace, seed, F.concat_ws("|", "side", "unit_id")), 1, 64))), [*keys, "side"], "_h", "_r", ("unit_id",), wide=wide)
    return ranked.filter(F.col("_r") <= size).drop("_h", "_r")


def fit(rows: DataFrame, split: DataFrame, keys: list[str], alpha: float, size: int | None = None, seed: int = 17) -> DataFrame:
    """keys, orientation, train_auroc, threshold, q_positive, q_negative, q and unit counts.

    Cells and radii are no more than the rows, so one count of these decides on the plan of all steps.
    """
    rows, wide = spread(rows)
    assigned = rows.join(split, "unit_id")
    train = once(cells(assigned.filter("split = 'train'"), keys))
    turned = once(orientation(train, keys, wide))
    oriented = on(keys, train, turned).withColumn("score", F.col("score") * F.col("orientation"))
    cut = threshold_argmax(oriented, keys, "score", "label", wide=wide).withColumnRenamed("balanced_accuracy", "train_balanced_accuracy")
    radii = once(calibration_radii(assigned.filter("split = 'calibration'"), keys, size, seed, wide=wide))
    q = conformal.quantile(radii, [*keys, "side"], "radius", alpha, wide=wide)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{n}_{s}") for s in ("positive", "negative") for c, n in (("q", "q"), ("n", "n"))])
    state = on(keys, on(keys, turned, cut), wide)
    return once(state.withColumn("q", F.greatest(F.coalesce("q_positive", F.lit(conformal.INF)), F.coalesce("q_negative", F.lit(conformal.INF)))))


def judged(rows: DataFrame, split: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Test roots with oriented score and certificate decision."""
    return _decided(rows.join(split.filter("split = 'test'"), "unit_id"), state, keys)


def _decided(test: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    joined = on(keys, analysis_roots(test), state).withColumn("score", F.col("score") * F.col("orientation"))
    return joined.withColumn("decision", conformal.decision(F.col("score"), F.col("threshold"), F.col("q"))).withColumn("side", conformal.side(F.col("label")))


def evaluate(rows: DataFrame, split: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: ranking and threshold metrics on test cells, abstention and selective
    accuracy over eligible roots, flips and coverage over variants, pair rates."""
    rows, wide = spread(rows)
    test = once(rows.join(split.filter("split = 'test'"), "unit_id"))
    cell = once(on(keys, cells(test, keys), state).withColumn("score", F.col("score") * F.col("orientation")))
    rank = on(keys, auroc(cell, keys, "score", "label", wide=wide), average_precision(cell, keys, "score", "label", wide=wide))
    hard = binary_suite(cell.withColumn("_margin", F.col("score") - F.col("threshold")), keys, "_margin", "label", F.lit(0.0)).drop("brier")
    roots = once(_decided(test, state, keys))
    sure = F.col("decision") != "abstain"
    right = (F.col("decision") == "valid") == (F.col("label") == 1)
    decided = roots.filter("eligible").groupBy(*keys).agg(F.avg((~sure).cast("double")).alias("abstention"), F.avg(F.when(sure, right.cast("double"))).alias("selective_accuracy"), F.count("*").alias("n_roots"))
    child = test.filter("kind = 'variant' and eligible").select(*keys, F.col("parent_id").alias("item_id"), F.col("score").alias("_child"))
    both = roots.select(*keys, "item_id", "unit_id", "score", "orientation", "threshold", "side", "q_positive", "q_negative").join(child, [*keys, "item_id"])
    changed = F.col("_child") * F.col("orientation")
    flip = (F.col("score") > F.col("threshold")) != (changed > F.col("threshold"))
    inside = conformal.covered(F.col("score"), changed, F.when(F.col("side") == "positive", F.col("q_positive")).otherwise(F.col("q_negative")))
    stable = both.groupBy(*keys).agg(F.avg(flip.cast("double")).alias("flip_rate"), F.avg(inside.cast("double")).alias("coverage"), F.count("*").alias("n_variants"))
    unit = conformal.group_mean(both, keys, "unit_id", {"unit_flip_rate": flip, "unit_coverage": inside})
    found = pairs.measure(pairs.resolve(test, keys), test, conformal.root_radii(test, keys), keys)
    found = once(on(keys, found, state).withColumn("gap", F.col("gap") * F.col("orientation")))
    certified = F.col("gap") > F.col("q_positive") + F.col("q_negative")
    pair = on(keys, pairs.summarise(found, keys), found.groupBy(*keys).agg(F.avg(certified.cast("double")).alias("certified")))
    out = on(keys, rank, hard)
    for part in (decided, stable, unit, pair):
        out = out.join(part, keys, "left") if keys else out.join(F.broadcast(part), F.lit(True), "left")
    return out


def run(rows: DataFrame, seed: int = 17, alpha: float = 0.1, size: int | None = None, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split, state, metrics)."""
    keys = keys or []
    rows = once(rows)
    split = once(exact_split(rows, "unit_id", seed))
    state = fit(rows, split, keys, alpha, size, seed)
    return split, state, evaluate(rows, split, state, keys)


def select_family(rows: DataFrame, split: DataFrame, family: list[str], candidate: str) -> DataFrame:
    """Best candidate of each family by train AUROC, ties to the smaller name, all in one fit."""
    train = cells(rows.join(split.filter("split = 'train'"), "unit_id"), [*family, candidate])
    scored = orientation(train, [*family, candidate])
    return scored.groupBy(*family).agg(F.min_by(F.struct(candidate, "orientation", "train_auroc"), F.struct(-F.col("train_auroc"), F.col(candidate))).alias("_b")).select(*family, "_b.*")
