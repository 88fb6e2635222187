"""Small fitted models: Platt scaling, a linear probe, residualised scores (``crossfit`` has
out-of-fold predictions).

Fits with a handful of coefficients are solved from distributed sums (gradient, Hessian or normal
equations): the rows never leave the executors, only a d x d matrix does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import hex_to_long, stable_hex
from gaugeframe.functions.scalars import logistic


def _sums(df: DataFrame, terms: dict[str, Column]) -> dict[str, float]:
    row = df.agg(*[F.sum(c).alias(n) for n, c in terms.items()]).first()
    return {n: float(row[n] or 0.0) for n in terms}


def fit_platt(df: DataFrame, score: str, label: str, penalty: float = 1.0, steps: int = 25) -> tuple[float, float] | None:
    """(slope, intercept) minimising the logistic loss plus penalty * slope^2 / 2, by Newton steps
    on sums; None if a class is empty."""
    rows = df.select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")).filter("x is not null and y is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    if not size["n"] or size["p"] in (0, size["n"]):
        return None
    shift, scale = float(size["m"]), float(size["s"]) or 1.0  # solved on standardised scores
    x, y = (F.col("x") - shift) / scale, F.col("y")
    a = b = 0.0
    for _ in range(steps):
        p = logistic(F.lit(a) * x + F.lit(b))
        t = _sums(rows, {"ga": (p - y) * x, "gb": p - y, "haa": p * (1 - p) * x * x, "hab": p * (1 - p) * x, "hbb": p * (1 - p)})
        lam = penalty / scale**2
        h = np.array([[t["haa"] + lam, t["hab"]], [t["hab"], t["hbb"]]])
        d = np.linalg.solve(h, [t["ga"] + lam * a, t["gb"]])
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-12:
            break
    return a / scale, b - a * shift / scale


def platt(score: Column, fitted: tuple[float, float] | None) -> Column:
    """The fitted probability; null where no fit was possible."""
    return F.lit(None).cast("double") if fitted is None else logistic(F.lit(fitted[0]) * score + F.lit(fitted[1]))


def spline_basis(x: Column, low: float | Column, high: float | Column, knots: int, linear: bool = False) -> list[Column]:
    """Cubic B-splines on evenly spaced knots from low to high, without the last one (the intercept's
    part): knots + 1 columns. Beyond the knots they stay as at the end, or go on along the slope."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    step = F.when(high > low, (high - low) / (knots - 1)).otherwise(F.lit(1.0))
    inside = F.greatest(low, F.least(high, x))
    out = []
    for i in range(knots + 1):
        s = (inside - low) / step - (i - 3)
        part = lambda power, s=s: sum((c * F.pow(F.greatest(F.lit(0.0), s - j), power) for j, c in enumerate((1, -4, 6, -4, 1))), F.lit(0.0))
        value = part(3) / 6
        out.append(value + (x - inside) * part(2) / 2 / step if linear else value)
    return out


def fit_ridge(df: DataFrame, features: list[Column], target: Column, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by normal equations on centred sums."""
    names = [f"f{i}" for i in range(len(features))]
    rows = df.select(*[f.cast("double").alias(n) for f, n in zip(features, names, strict=True)], target.cast("double").alias("y"))
    every = [*names, "y"]
    terms = {f"s_{a}": F.col(a) for a in every} | {f"p_{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(every) for b in every[i:]} | {"n": F.lit(1.0)}
    t = _sums(rows, terms)
    n = max(t["n"], 1.0)
    cov = lambda a, b: t.get(f"p_{a}_{b}", t.get(f"p_{b}_{a}")) - t[f"s_{a}"] * t[f"s_{b}"] / n
    g = np.array([[cov(a, b) for b in names] for a in names]) + alpha * np.eye(len(names))
    w = np.linalg.solve(g, [cov(a, "y") for a in names])
    return w, t["s_y"] / n - sum(c * t[f"s_{a}"] / n for c, a in zip(w, names, strict=True))


def residualise(df: DataFrame, fit_rows: DataFrame, target: str, nuisances: list[str], alpha: float = 1.0, name: str = "residual") -> DataFrame:
    """Adds ``name``: target minus a spline ridge on the nuisances, fitted on fit_rows only (train
    roots) and applied to all rows; null where a nuisance is."""
    bounds = fit_rows.agg(F.count("*").alias("n"), *[f(c).cast("double").alias(f"{k}_{c}") for c in nuisances for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if bounds["n"] < 4:
        raise ValueError("at least four rows are needed to residualise")
    knots = min(5, max(2, bounds["n"] // 4))
    basis = [b for c in nuisances for b in spline_basis(F.col(c).cast("double"), bounds[f"lo_{c}"], bounds[f"hi_{c}"], knots)]
    center = fit_rows.agg(*[f(b).alias(f"{k}{i}") for i, b in enumerate(basis) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [(b - F.lit(float(center[f"m{i}"]))) / F.lit(float(center[f"s{i}"] or 1.0)) for i, b in enumerate(basis)]
    w, intercept = fit_ridge(fit_rows, scaled, F.col(target), alpha)
    guess = F.lit(float(intercept))
    for c, b in zip(w, scaled, strict=True):
        guess = guess + F.lit(float(c)) * b
    return df.withColumn(name, F.col(target) - guess)


def residualise_all(df: DataFrame, fit_rows: DataFrame, targets: list[str], nuisances: list[str]) -> tuple[DataFrame, list[str]]:
    """One residual per target: (rows, names)."""
    suffix, names = "_and_".join(n.replace(".", "_") for n in nuisances), []
    for target in targets:
        names.append(f"residualised_{target}_on_{suffix}")
        df = residualise(df, fit_rows, target, nuisances, name=names[-1])
    return df, names


def hash_folds(unit: Column, n: int, seed: int, namespace: str = "fold") -> Column:
    """Fold of a unit: all rows of a unit share it."""
    return (hex_to_long(stable_hex(namespace, seed, unit)) % n).cast("int")


def linear_probe(df: DataFrame, features: str, label: str, unit: str, fit_rows: Column, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 3, seed: int = 17) -> DataFrame:
    """Adds logit: a class-balanced, standardised logistic model on an array column, fitted on
    fit_rows; its C is the one of best mean AUROC over unit folds (ties to the smaller)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from gaugeframe.operators.rankstats import auroc

    rows = df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double")).withColumn("_f", hash_folds(F.col(unit), folds, seed))
    train = rows.filter(fit_rows).persist()  # read by every fit; let go below

    def fitted(part: DataFrame, c: float):
        scaler = StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True).fit(part)
        n = part.agg(F.count("*").alias("n"), F.sum("_y").alias("p")).first()
        weight = F.when(F.col("_y") == 1, n["n"] / (2.0 * max(n["p"], 1))).otherwise(n["n"] / (2.0 * max(n["n"] - n["p"], 1)))
        model = LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", regParam=1 / (c * max(n["n"], 1)), standardization=False, tol=1e-9, maxIter=200).fit(scaler.transform(part).withColumn("_w", weight))
        return lambda x: model.transform(scaler.transform(x)).withColumn("logit", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("_s", "rawPrediction", "probability", "prediction")

    def quality(c: float) -> float:
        scores = []
        for k in range(folds):
            held = fitted(train.filter(F.col("_f") != k), c)(train.filter(F.col("_f") == k))
            scores.append(auroc(held, [], "logit", "_y", wide=False).first()["auroc"])
        return float(np.nanmean(scores))

    best = grid[0] if len(grid) == 1 else max(grid, key=lambda c: (quality(c), -c))
    out = fitted(train, best)(rows).drop("_x", "_y", "_f")
    train.unpersist()
    return out.withColumn("c", F.lit(best))
