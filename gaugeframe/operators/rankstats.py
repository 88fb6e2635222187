"""Ranking, calibration and threshold statistics; every function takes grouping keys.

Ties are exact: rows are first grouped by score, which also shrinks what is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.operators.prefix import on, once, rank_table, running, spread, total, with_buckets

NAN = float("nan")


def blocks(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Positives p and negatives n at each score."""
    w = F.lit(1) if weight is None else weight
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(total(F.when(F.col(label) == 1, w)).alias("p"), total(F.when(F.col(label) == 0, w)).alias("n"))


def auroc(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None, wide: bool = True) -> DataFrame:
    """Rank AUROC with ties as half; NaN if a class is empty. ``weight`` counts rows repeatedly."""
    cum = running(blocks(df, keys, score, label, weight), keys, score, {"upto": "n"}, wide=wide)
    both = F.sum("p") * F.sum("n")
    value = F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2.0))
    return cum.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.when(both > 0, value / F.nullif(both, F.lit(0))).otherwise(F.lit(NAN)).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, wide: bool = True) -> DataFrame:
    """Sum over tie blocks of the recall gained times the precision at the block's end."""
    cum = running(blocks(df, keys, score, label).withColumn("all", F.col("p") + F.col("n")), keys, score, {"tp": "p", "seen": "all"}, descending=True, wide=wide)
    value = F.sum(F.col("p") * F.col("tp") / F.col("seen"))
    return cum.groupBy(*keys).agg(F.when(F.sum("p") > 0, value / F.nullif(F.sum("p"), F.lit(0))).otherwise(F.lit(NAN)).alias("average_precision"))


def ece_bins(df: DataFrame, keys: list[str], probability: str, label: str, bins: int = 15) -> DataFrame:
    number = F.least(F.floor(F.col(probability) * bins).cast("int"), F.lit(bins - 1))
    return df.withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("mean_label"), F.avg(probability).alias("mean_probability"))


def ece(df: DataFrame, keys: list[str], probability: str, label: str, bins: int = 15) -> DataFrame:
    gap = F.abs(F.col("mean_label") - F.col("mean_probability"))
    return ece_bins(df, keys, probability, label, bins).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def aurc(df: DataFrame, keys: list[str], confidence: str, error: str, tie: str) -> DataFrame:
    """Mean running error rate in order of falling confidence; equal confidences by ``tie``."""
    cum = running(df.withColumn("_e", F.col(error).cast("bigint")).withColumn("_one", F.lit(1).cast("bigint")), keys, confidence, {"wrong": "_e", "seen": "_one"}, descending=True, ties=(tie,))
    return cum.groupBy(*keys).agg(F.avg(F.col("wrong") / F.col("seen")).alias("aurc"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def binary_suite(df: DataFrame, keys: list[str], score: str, label: str, threshold: Column, probability: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, harmonic mean of the class accuracies, Brier score."""
    positive, truth = F.col(score) > threshold, F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(positive & truth).alias("tp"), F.count_if(positive & ~truth).alias("fp"), F.count_if(~positive & truth).alias("fn"), F.count_if(~positive & ~truth).alias("tn"),
        (F.avg(F.pow(F.col(probability) - F.col(label), 2)) if probability else F.lit(NAN)).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr = F.coalesce(F.try_divide(tp, tp + fn), F.lit(NAN)), F.coalesce(F.try_divide(tn, tn + fp), F.lit(NAN))
    return counts.select(
        *keys, "tp", "fp", "fn", "tn", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((tpr + tnr) / 2).alias("balanced_accuracy"),
        ((_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2).alias("macro_f1"), F.coalesce(F.try_divide(2 * tpr * tnr, tpr + tnr), F.lit(0.0)).alias("harmonic"), "brier",
    )


def threshold_argmax(df: DataFrame, keys: list[str], score: str, label: str, wide: bool = True) -> DataFrame:
    """Threshold of best balanced accuracy under ``score > threshold``.

    Candidates are the double below the least score, the midpoints of neighbouring distinct scores,
    and the largest score; among those within 1e-15 of the best the smallest wins.
    """
    from gaugeframe.functions.scalars import below

    grouped, wide = spread(blocks(df, keys, score, label).withColumn("one", F.lit(1).cast("bigint")), wide)
    cum = running(grouped, keys, score, {"p_upto": "p", "n_upto": "n", "place": "one"}, wide=wide)
    cum = once(cum) if wide else cum
    if not wide:
        ahead = Window.partitionBy(*keys).orderBy(score)
        cum = cum.withColumn("_next", F.lead(score).over(ahead))
        every = Window.partitionBy(*keys)
        full = cum.withColumn("_p", F.sum("p").over(every)).withColumn("_n", F.sum("n").over(every)).withColumn("_least", F.min(score).over(every)).filter("_p > 0 and _n > 0")
        quality = ((F.col("_p") - F.col("p_upto")) / F.col("_p") + F.col("n_upto") / F.col("_n")) / 2.0
        own = F.struct(F.coalesce((F.col(score) + F.col("_next")) / 2.0, F.col(score)).alias("t"), quality.alias("ba"))
        edge = F.struct(below(F.col("_least").cast("double")).alias("t"), F.lit(0.5).alias("ba"))
        points = full.select(*keys, F.explode(F.array(own, edge)).alias("x")).select(*keys, "x.t", "x.ba", F.max("x.ba").over(every).alias("best"))
        return points.filter("best - ba <= 1e-15").groupBy(*keys).agg(F.min("t").alias("threshold"), F.max("best").alias("balanced_accuracy"))
    # the next distinct score, by place: an equi-join instead of a window over all scores
    after = cum.select(*keys, (F.col("place") - 1).alias("place"), F.col(score).alias("_next"))
    cum = cum.join(after, [*keys, "place"], "left")
    totals = cum.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"), F.min(score).alias("_least"))
    full = on(keys, cum, totals).filter("_p > 0 and _n > 0")
    quality = ((F.col("_p") - F.col("p_upto")) / F.col("_p") + F.col("n_upto") / F.col("_n")) / 2.0
    points = full.select(*keys, F.coalesce((F.col(score) + F.col("_next")) / 2.0, F.col(score)).alias("t"), quality.alias("ba"))
    points = points.unionByName(totals.filter("_p > 0 and _n > 0").select(*keys, below(F.col("_least").cast("double")).alias("t"), F.lit(0.5).alias("ba")))
    best = points.groupBy(*keys).agg(F.max("ba").alias("best"))
    return on(keys, points, best).filter("best - ba <= 1e-15").groupBy(*keys).agg(F.min("t").alias("threshold"), F.max("best").alias("balanced_accuracy"))


def spearman(df: DataFrame, keys: list[str], target: str, controls: list[str]) -> DataFrame:
    """Rank correlation of target with each control: (keys, control, rho)."""
    long = df.select(*keys, target, F.expr(f"stack({len(controls)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in controls) + ") as (control, value)")).filter(F.col(target).isNotNull() & F.col("value").isNotNull())
    by, long = [*keys, "control"], once(long)
    ranked = long.join(rank_table(long, by, target, "_rt"), [*by, target]).join(rank_table(long, by, "value", "_rv"), [*by, "value"])
    return ranked.groupBy(*by).agg(F.corr("_rt", "_rv").alias("rho"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, tie: str) -> DataFrame:
    """Adds p_adjusted: the least p * n / rank at or after each test's place in order. Families beyond
    one window's size are spread over buckets."""
    rows, wide = spread(df)
    if not wide:
        order = Window.partitionBy(*keys).orderBy(p, tie)
        ranked = rows.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        suffix = order.rowsBetween(0, Window.unboundedFollowing)
        return ranked.withColumn("p_adjusted", F.least(F.min(F.col(p) * F.col("_n") / F.col("_k")).over(suffix), F.lit(1.0))).drop("_k", "_n")
    ranked = running(rows.withColumn("_one", F.lit(1).cast("bigint")), keys, p, {"_k": "_one"}, ties=(tie,)).drop("_one")
    sized = on(keys, ranked, rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    placed = once(with_buckets(once(sized.withColumn("_raw", F.col(p) * F.col("_n") / F.col("_k"))), keys, p))
    later = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    after = placed.groupBy(*keys, "_b").agg(F.min("_raw").alias("_least")).withColumn("_later", F.min("_least").over(later)).drop("_least")
    inside = Window.partitionBy(*keys, "_b").orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    local = placed.withColumn("_own", F.min("_raw").over(inside)).join(after, [*keys, "_b"])
    return local.withColumn("p_adjusted", F.least("_own", F.coalesce("_later", F.lit(1.0)), F.lit(1.0))).drop("_k", "_n", "_raw", "_b", "_own", "_later")
