"""Graph kernels on dense per-row matrices, as Arrow-batched functions, and token statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "fiedler double, energy double, smoothness double, hfer double, spectral_entropy double"


def head_graph(attention: np.ndarray, epsilon: float = 1e-12) -> np.ndarray:
    """[heads, t, t] to one symmetric graph: heads weighted by their mass, no loops, small weights 0."""
    a = np.asarray(attention, float)
    mass = a.sum((1, 2))
    share = mass / mass.sum() if mass.sum() > epsilon else np.full(len(a), 1 / len(a))
    g = np.clip(np.tensordot(share, (a + a.transpose(0, 2, 1)) / 2, 1), 0, None)
    np.fill_diagonal(g, 0)
    g[g < epsilon] = 0
    return g


def laplacian(graph: np.ndarray, normalised: bool = False, epsilon: float = 1e-12) -> np.ndarray:
    degree = graph.sum(1)
    if not normalised:
        return np.diag(degree) - graph
    alive = degree > epsilon
    root = np.where(alive, 1 / np.sqrt(np.where(alive, degree, 1)), 0)
    return np.diag(alive.astype(float)) - root[:, None] * graph * root[None, :]


def scores(graph: np.ndarray, signal: np.ndarray, high: float = 0.5, epsilon: float = 1e-12) -> tuple[float, ...]:
    """Second eigenvalue, Dirichlet energy, smoothness, share of energy in the top eigenvectors,
    entropy of the energy over eigenvectors."""
    n = len(graph)
    if n < 2:
        return 0.0, 0.0, 1.0, 0.0, 0.0
    values, vectors = np.linalg.eigh(laplacian(graph))
    energy = float(np.einsum("tf,ts,sf->", signal, laplacian(graph), signal))
    part = ((vectors.T @ signal) ** 2).sum(1)
    total = part.sum()
    p = part / total if total > epsilon else np.full(n, 1 / n)
    top = int(np.ceil(high * n))
    entropy = float(-(p[p > 0] * np.log(p[p > 0])).sum())
    return float(values[1]), energy, 1 / (1 + energy / max(float(total), epsilon)), float(p[n - top :].sum()), entropy


def spectral_scores(df: DataFrame, key: str, graph: str, signal: str, most: int = 512) -> DataFrame:
    """key and spectral scores of a graph (array of rows) with a signal (array of rows); above
    ``most`` tokens evenly spaced ones are kept."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for k, g, x in zip(pdf[key], pdf[graph], pdf[signal], strict=True):
                g, x = np.array([np.asarray(r, float) for r in g]), np.array([np.asarray(r, float) for r in x])
                if len(g) > most:
                    at = (np.arange(most) * (len(g) - 1) / (most - 1)).astype(int)
                    g, x = g[np.ix_(at, at)], x[at]
                rows.append((k, *scores(head_graph(g[None]), x)))
            yield pd.DataFrame(rows, columns=[key, "fiedler", "energy", "smoothness", "hfer", "spectral_entropy"])

    return df.select(key, graph, signal).mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def token_statistics(log_probs: Column, entropies: Column) -> dict[str, Column]:
    """Mean and sum log-likelihood, perplexity, mean, largest and population variance of entropy."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    n = F.nullif(F.size(log_probs), F.lit(0)).cast("double")
    mean = total(log_probs) / n
    m = total(entropies) / n
    return {"mean_ll": mean, "sum_ll": total(log_probs), "perplexity": F.exp(-mean), "mean_entropy": m, "max_entropy": F.array_max(entropies), "var_entropy": total(F.transform(entropies, lambda x: (x - m) * (x - m))) / n}
