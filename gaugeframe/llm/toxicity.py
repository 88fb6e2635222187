"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratio features.

Texts are read as lower-case letters with everything else as a space; features say which hashed
n-grams of 4 to 6 bytes a text holds. Each is scaled by the log ratio of its smoothed document
frequencies in toxic and clean texts; a logistic regression is trained on the scaled features.

The fit uses a bounded sample of the labelled rows (``most_toxic`` and ``most_clean`` rows, those
with the smallest hash of their id), weighted back to the true share of each label, so scores are
probabilities at the corpus rate. The sample's ids are the only broadcast (their number is the
bound); the sampled texts are written to the shared folder once; their features reach the driver as one bit per feature and row. Scoring covers whole texts.

Defined cases: null and empty texts hold no feature and get the fitted bias as their score; labels that are
null or not 0 or 1 train nothing; with one label or none in the sample the score is its smoothed
rate; repeated labelled ids count once (largest label); repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import fold, map_text, stored, table
from gaugeframe.llm.langid import _CLASS

BITS, ORDERS = 20, (4, 5, 6)
RESULT = "score double, predicted int"


def grams(raw: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, tables[order][bucket]) of every n-gram whose entry is not negative."""
    c = _CLASS[raw].astype(np.uint64)
    n = len(c)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the text's end
    rows, values = [], []
    code = np.zeros(n, np.uint64)
    for k in range(max(ORDERS)):
        if n <= k:
            break
        code = (code[: n - k] << np.uint64(8)) | c[k:]
        if k + 1 in ORDERS:
            got = tables[ORDERS.index(k + 1)][(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)]
            at = np.flatnonzero(got >= 0)
            at = at[left[at] > k]
            rows.append(np.searchsorted(offsets, at, "right") - 1)
            values.append(got[at])
    return (np.concatenate(rows), np.concatenate(values)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))


class Model:
    """Features: bucket of each order to feature number (or -1); weight of each feature; bias."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray, bias: float) -> None:
        self.tables, self.weights, self.bias = tables, weights.astype(np.float32), bias

    def present(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(offsets) - 1, len(self.weights)), bool)
        rows, values = grams(raw, offsets, self.tables)
        seen[rows, values] = True
        return seen

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.present(raw, offsets).astype(np.float32) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, most: tuple[int, int]) -> tuple[DataFrame, dict[int, int]]:
    one = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and _key is not null").groupBy("_key").agg(F.max("y").alias("y"))
    counts = {int(r.y): int(r.n) for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = lambda y, n: one.filter(F.col("y") == y).orderBy(F.xxhash64("_key"), "_key").limit(n)
    ids = part(1, most[0]).unionByName(part(0, most[1]))  # at most sum(most) rows: a proven bound
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("t")).join(F.broadcast(ids), "_key")
    return stored(rows.select("t", "y"), "toxicity-sample"), counts


def _frequencies(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """(bucket, n0, n1): document frequencies by label of all hashed n-grams in the sample, summed on
    the executors; and the sample's size by label."""

    def run(batches):
        df = np.zeros((2, len(ORDERS) << BITS), np.int32)
        every = [np.arange(i << BITS, (i + 1) << BITS, dtype=np.int64) for i in range(len(ORDERS))]
        for batch in batches:
            for part in _bytes.slices(batch, "t", 1 << 20):
                raw, offsets = _bytes.view(part.column(0))
                y = np.array(part.column(1))
                row, value = grams(raw, offsets, every)
                row, value = np.divmod(np.unique(row * (len(ORDERS) << BITS) + value), len(ORDERS) << BITS)
                for c in (0, 1):
                    df[c] += np.bincount(value[y[row] == c], minlength=df.shape[1]).astype(np.int32)
        found = np.flatnonzero(df.any(0))
        for i in range(0, len(found), 1 << 16):
            at = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[0][at]), pa.array(df[1][at])], names=["bucket", "n0", "n1"])

    size = {int(r.y): int(r.n) for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counted = rows.mapInArrow(run, "bucket int, n0 int, n1 int").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return counted, [size.get(0, 0), size.get(1, 0)]


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", most_toxic: int = 4000, most_clean: int = 8000, n_features: int = 4096, penalty: float = 1.0) -> Model:
    rows, counts = _sample(docs, labels, text, key, label, (most_toxic, most_clean))
    df, size = _frequencies(rows)
    rate = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    empty = [np.full(1 << BITS, -1, np.int32) for _ in ORDERS]
    base = float(np.log(rate / (1 - rate)))
    if not min(size):
        return Model(empty, np.zeros(1), base)
    # log-count ratio with add-one smoothing, and how many standard errors it is from zero
    p, q = (F.col("n1") + 1.0) / (size[1] + 2.0), (F.col("n0") + 1.0) / (size[0] + 2.0)
    pool = (F.col("n0") + F.col("n1") + 1.0) / (sum(size) + 2.0)
    strength = F.abs(p - q) / F.sqrt(pool * (1 - pool) * (1 / size[0] + 1 / size[1]))
    strong = df.filter(F.col("n0") + F.col("n1") >= 3).select("bucket", F.log(p / q).alias("ratio"), strength.alias("strength")).filter("strength > 0")
    best = sorted((r.bucket, r.ratio) for r in strong.orderBy(F.desc("strength"), "bucket").limit(n_features).collect())
    chosen = np.array([x for x, _ in best], np.int64)
    if not len(chosen):
        return Model(empty, np.zeros(1), base)
    table_ = np.full(len(ORDERS) << BITS, -1, np.int32)
    table_[chosen] = np.arange(len(chosen))
    model = Model(list(table_.reshape(len(ORDERS), -1)), np.zeros(len(chosen)), base)
    scale = np.array([x for _, x in best])

    def bits(batches):
        for batch in batches:
            for part in _bytes.slices(batch, "t", 1 << 20):
                seen = model.present(*_bytes.view(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x.tobytes() for x in np.packbits(seen, 1)], pa.binary())], names=["y", "x"])

    got = sorted((r.y, bytes(r.x)) for r in rows.mapInArrow(bits, "y int, x binary").collect())  # one bit per feature and sampled row
    y = np.array([a for a, _ in got], np.float64)
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in got]), axis=1)[:, : len(chosen)]
    weight = np.where(y == 1, counts[1] / max(1, size[1]), counts[0] / max(1, size[0]))
    w, bias = _logistic(x, y, weight / weight.mean(), scale.astype(np.float32), penalty)
    return Model(model.tables, w * scale, bias)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: np.ndarray, penalty: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the weighted mean loss; rows are unpacked a block at a time."""
    n, d = x.shape
    blocks = [slice(i, i + 1024) for i in range(0, n, 1024)]
    v = np.ones(d)
    for _ in range(12):  # the largest curvature
        u = sum(scale * ((x[b].astype(np.float32) @ (scale * v).astype(np.float32) * weight[b]) @ x[b].astype(np.float32)) for b in blocks) / n
        norm = float(np.linalg.norm(u)) or 1.0
        v = u / norm
    step = 1 / (0.25 * (norm * 1.1 + 2.0) + penalty / n)
    w = z = np.zeros(d)
    bias = zb = float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
    for t in range(1, steps + 1):
        g, gb = np.zeros(d), 0.0
        for b in blocks:
            f = x[b].astype(np.float32)
            e = weight[b] * (1 / (1 + np.exp(-(f @ (scale * z).astype(np.float32) + zb))) - y[b])
            g += scale * (e.astype(np.float32) @ f)
            gb += e.sum()
        new, nb = z - step * (g / n + penalty / n * z), zb - step * gb / n
        z, zb = new + (t - 1) / (t + 2) * (new - w), nb + (t - 1) / (t + 2) * (nb - bias)
        w, bias = new, nb
    return w, float(bias)


class _Kernel:
    def __init__(self, model, cut: float) -> None:
        self.model, self.cut = model, cut

    def __call__(self, column: pa.Array) -> list:
        s = self.model.value.score(*_bytes.view(column))
        return [s, (s >= self.cut).astype(np.int32)]


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, cut: float = 0.7) -> DataFrame:
    return map_text(docs, text, docs.columns if keep is None else keep, RESULT, _Kernel(docs.sparkSession.sparkContext.broadcast(model), cut))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    out = predict(docs, fit(docs, labels), keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
