"""Cross-fitted predictions: stratified hash folds, and small models fitted for all folds at once.

Every (seed, fold, method) is a group. Rows meet the groups whose training part they belong to, and
each Newton step is one aggregate over all groups: only d x d sums per group reach the driver, and
their number is seeds x folds x methods.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import stable_hex
from gaugeframe.functions.scalars import logistic
from gaugeframe.operators import inference, rankstats
from gaugeframe.operators.models import spline_basis
from gaugeframe.operators.prefix import hash_rank, once

METHODS = ("size", "signal", "size_plus_signal", "size_plus_level", "signal_residualised")


def stratified_folds(df: DataFrame, key: str, label: str, seeds: tuple[int, ...], folds: int) -> DataFrame:
    """Rows (once per seed) with seed and fold: each label's rows are dealt in hash order."""
    out = []
    for seed in seeds:
        hashed = df.filter(F.col(label).isNotNull()).withColumn("_h", stable_hex("fold", seed, F.col(key)))
        ranked = hash_rank(hashed, [label], "_h", "_r", (key,))
        out.append(ranked.withColumn("seed", F.lit(seed)).withColumn("fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_h", "_r"))
    return reduce(DataFrame.unionByName, out)


def _group_sums(rows: DataFrame, terms: dict[str, Column]) -> dict[tuple, dict]:
    got = rows.groupBy("seed", "held").agg(*[F.sum(v).alias(k) for k, v in terms.items()]).collect()  # seeds x folds rows
    return {(r["seed"], r["held"]): r.asDict() for r in got}


def _standardised(rows: DataFrame, names: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray, int]]:
    t = _group_sums(rows, {"n": F.lit(1.0)} | {f"s_{x}": F.col(x) for x in names})
    means = {g: np.array([r[f"s_{x}"] / r["n"] for x in names]) for g, r in t.items()}
    # squares around the mean: sums of raw squares would lose digits
    around = _with(rows, {g: {f"m_{x}": float(m[i]) for i, x in enumerate(names)} for g, m in means.items()})
    q = _group_sums(around, {f"q_{x}": F.pow(F.col(x) - F.col(f"m_{x}"), 2) for x in names})
    return {g: (means[g], np.array([np.sqrt(q[g][f"q_{x}"] / t[g]["n"]) or 1.0 for x in names]), int(t[g]["n"])) for g in t}


def _with(rows: DataFrame, values: dict[tuple, dict[str, float]]) -> DataFrame:
    """Rows with per-group numbers, by broadcast of one row per group."""
    names = list(next(iter(values.values()), {}))
    table = rows.sparkSession.createDataFrame([(*g, *[float(v[n]) for n in names]) for g, v in values.items()], "seed int, held int" + "".join(f", `{n}` double" for n in names))
    return rows.join(F.broadcast(table), ["seed", "held"])


def _scaled(rows: DataFrame, names: list[str], scale: dict) -> DataFrame:
    both = _with(rows, {g: {f"m_{x}": m[i] for i, x in enumerate(names)} | {f"d_{x}": s[i] for i, x in enumerate(names)} for g, (m, s, _) in scale.items()})
    drop = [f"{k}_{x}" for x in names for k in "md"]
    return both.select("*", *[((F.col(x) - F.col(f"m_{x}")) / F.col(f"d_{x}")).alias(f"z_{x}") for x in names]).drop(*drop)


def _linear(names: list[str]) -> Column:
    return reduce(lambda a, x: a + F.col(f"w_{x}") * F.col(f"z_{x}"), names, F.col("w_"))


def _newton_sums(train: DataFrame, names: list[str], weights: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """Per group gradient and Hessian of the logistic loss (the Hessian below the gradient): every
    partition sums its own rows, one small matrix per partition and group reaches the driver."""
    d = len(names) + 1

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            seed, fold, y, *z = (np.array(c) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *z])
            for g in {(int(a), int(b)) for a, b in zip(seed, fold, strict=True)}:
                own = (seed == g[0]) & (fold == g[1])
                xs = x[own]
                p = 1 / (1 + np.exp(-np.clip(xs @ weights[g], -500, 500)))
                held.setdefault(g, np.zeros((d + 1, d)))
                held[g] += np.vstack([(p - y[own]) @ xs, xs.T @ (xs * (p * (1 - p))[:, None])])
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in held], pa.int32()), pa.array([g[1] for g in held], pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())], names=["seed", "held", "m"])

    out: dict[tuple, np.ndarray] = {}
    for r in train.select("seed", "held", "_y", *[f"z_{x}" for x in names]).mapInArrow(run, "seed int, held int, m binary").collect():
        g = (r["seed"], r["held"])
        out[g] = out.get(g, 0) + np.frombuffer(bytes(r["m"])).reshape(d + 1, d)
    return out


def _logistic_fit(train: DataFrame, names: list[str], c: float = 1.0, steps: int = 12) -> dict[tuple, np.ndarray]:
    """Weights (intercept first) of an L2 logistic model on the z_ columns, per group."""
    d = len(names) + 1
    weights = {(r["seed"], r["held"]): np.zeros(d) for r in train.select("seed", "held").distinct().collect()}
    ridge = np.diag([1e-9] + [1 / c] * (d - 1))
    for _ in range(steps):
        worst = 0.0
        for g, m in _newton_sums(train, names, weights).items():
            step = np.linalg.solve(m[1:] + ridge, m[0] + ridge @ weights[g])
            weights[g] = weights[g] - step
            worst = max(worst, float(np.abs(step).max()))
        if worst < 1e-8:
            break
    return weights


def _ridge_fit(train: DataFrame, names: list[str], alpha: float = 1.0) -> dict[tuple, np.ndarray]:
    z = [F.col(f"z_{x}") for x in names]
    d = len(z)
    t = _group_sums(train, {"n": F.lit(1.0), "y": F.col("_t")} | {f"b{i}": z[i] * F.col("_t") for i in range(d)} | {f"a{i}_{j}": z[i] * z[j] for i in range(d) for j in range(i, d)})
    # the z columns have mean zero in the training part
    return {g: np.concatenate([[r["y"] / r["n"]], np.linalg.solve(np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + alpha * np.eye(d), [r[f"b{i}"] for i in range(d)])]) for g, r in t.items()}


def _applied(rows: DataFrame, names: list[str], weights: dict, as_: str, raw: bool = False) -> DataFrame:
    placed = _with(rows, {g: {"w_": w[0]} | {f"w_{x}": w[i + 1] for i, x in enumerate(names)} for g, w in weights.items()})
    value = _linear(names)
    return placed.withColumn(as_, value if raw else logistic(value)).drop("w_", *[f"w_{x}" for x in names])


def _splined(rows: DataFrame, columns: list[str], knots: int) -> tuple[DataFrame, list[str]]:
    """Spline columns whose knots span the training part of each group."""
    got = rows.filter("_train").groupBy("seed", "held").agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    placed = _with(rows, {(r["seed"], r["held"]): {f"{k}_{c}": r[f"{k}_{c}"] for c in columns for k in ("lo", "hi")} for r in got})
    made = {f"{c}_s{i}": b for c in columns for i, b in enumerate(spline_basis(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), knots, linear=True))}
    return placed.select("*", *[b.alias(n) for n, b in made.items()]).drop(*[f"{k}_{c}" for c in columns for k in ("lo", "hi")]), list(made)


def _classified(rows: DataFrame, names: list[str], as_: str) -> DataFrame:
    """Held-out rows with the probability of a scaled logistic model fitted on the group's train rows."""
    rows = once(rows.select("_key", "_y", "seed", "held", "_train", *names))
    scaled = once(_scaled(rows, names, _standardised(rows.filter("_train"), names)).select("_key", "_y", "seed", "held", "_train", *[f"z_{x}" for x in names]))
    return once(_applied(scaled.filter("not _train"), names, _logistic_fit(scaled.filter("_train"), names), as_))


def predictions(df: DataFrame, key: str, label: str, size: str, signal: str, level: str, seeds: tuple[int, ...] = (17,), folds: int = 5, knots: int = 5) -> tuple[DataFrame, DataFrame]:
    """(key, label, seed, fold and the out-of-fold probability of every method; AUROC per seed, fold
    and method).

    Methods: a spline of size, the signal, splines of size with the signal or the level, and the
    signal with its spline on size taken out. Rows with a null take no part.
    """
    base = df.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(n) for c, n in ((size, "size"), (signal, "signal"), (level, "level"))]).dropna()
    dealt = stratified_folds(once(base), "_key", "_y", seeds, folds)
    rows = once(dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")).withColumn("_train", F.col("fold") != F.col("held")))
    out = rows.filter("not _train").select("_key", "_y", "seed", "fold")
    sets = {"size": ["size"], "signal": [], "size_plus_signal": ["size", "signal"], "size_plus_level": ["size", "level"]}
    for name, columns in sets.items():
        own, names = _splined(rows, columns, knots) if columns else (rows, ["signal"])
        out = out.join(_classified(own, names, f"p_{name}").select("_key", "seed", f"p_{name}"), ["_key", "seed"])
    own, names = _splined(rows, ["size"], knots)
    own = once(own)
    scaled = once(_scaled(own, names, _standardised(own.filter("_train"), names)).withColumn("_t", F.col("signal")))
    left = _applied(scaled, names, _ridge_fit(scaled.filter("_train"), names), "_guess", raw=True).withColumn("rest", F.col("signal") - F.col("_guess"))
    out = out.join(_classified(left.select("_key", "_y", "seed", "held", "_train", "rest"), ["rest"], "p_signal_residualised").select("_key", "seed", "p_signal_residualised"), ["_key", "seed"])
    long = out.unpivot(["_key", "_y", "seed", "fold"], [f"p_{m}" for m in METHODS], "method", "probability")
    quality = rankstats.auroc(long, ["seed", "fold", "method"], "probability", "_y").select("seed", "fold", F.regexp_replace("method", "^p_", "").alias("method"), "auroc")
    return out.select(F.col("_key").alias(key), F.col("_y").cast("int").alias(label), "seed", "fold", *[f"p_{m}" for m in METHODS]), quality


def audit(df: DataFrame, key: str, labels: list[str], size: str, signal: str, level: str, seeds: tuple[int, ...], folds: int = 5, replicates: int = 200) -> tuple[DataFrame, DataFrame]:
    """(label, method, mean and deviation of the seeds' AUROC; per label the interval of
    AUROC(size_plus_signal) - AUROC(size) over rows, for the last seed)."""
    summaries, intervals = [], []
    for label in labels:
        out, _ = predictions(df, key, label, size, signal, level, seeds, folds)
        out = once(out)
        long = out.unpivot(["seed", label], [f"p_{m}" for m in METHODS], "method", "probability")
        per = rankstats.auroc(long, ["seed", "method"], "probability", label)
        summaries.append(per.groupBy("method").agg(F.avg("auroc").alias("mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("std")).select(F.lit(label).alias("label"), F.regexp_replace("method", "^p_", "").alias("method"), "mean", "std"))
        last = out.filter(F.col("seed") == seeds[-1]).withColumn("_row", F.col(key).cast("string"))
        intervals.append(inference.bootstrap_auc_difference(last, "_row", label, "p_size_plus_signal", "p_size", replicates, seeds[-1]).select(F.lit(label).alias("label"), "*"))
    return reduce(DataFrame.unionByName, summaries), reduce(DataFrame.unionByName, intervals)
