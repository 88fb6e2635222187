"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits. One binary classifier per bit weighs hashed n-grams by the
log ratio of their probability under the languages whose bit is 1 and under those whose bit is 0
(each language counts the same in its group). A text's margins for all bits are decoded to the
codeword of least summed logistic loss, where a bit counts by how well it separates the training
counts. Neighbouring n-grams repeat each other's evidence, so a text's margin is its mean per n-gram
times its n-grams, but no more than ``EVIDENCE`` of them: a long text of two languages stays close
to both codewords. A runner-up that comes close is flagged as ambiguous.

Training counts cover every labelled training text; they meet in one table of at most
``languages x 2 x 65536`` counts, whatever the corpus holds.

Defined cases: a text that is null or has no letter gets "und" with score 0 and is not ambiguous;
rows whose label is null train nothing; without any training text all rows are "und"; repeated rows
are predicted alike; scores lie in [0, 1].
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import fold, map_text, table

BUCKETS = 1 << 16
EVIDENCE = 64
RESULT = "lang_pred string, score double, runner_up string, ambiguous boolean"
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def features(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 2-gram and the 3-gram that starts at each byte; BUCKETS where none does."""
    c = _CLASS[raw].astype(np.uint32)
    n = len(c)
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    two = np.full(n, BUCKETS, np.int32)
    three = np.full(n, BUCKETS, np.int32)
    if n > 1:
        code = (c[:-1] << np.uint32(8)) | c[1:]
        two[:-1] = np.where(last[:-1] | (code == 0x2020), BUCKETS, code)
    if n > 2:
        code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        three[:-2] = np.where(last[:-2] | last[1:-1] | ((code & np.uint32(0xFFFF)) == 0x2020), BUCKETS, (code * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return [two, three]


def has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((_CLASS[raw] != 0x20) & (raw < 0x80))])
    found = (ascii_letter[offsets[1:]] - ascii_letter[offsets[:-1]]) > 0
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(ch.isalpha() for ch in column[int(i)].as_py() or "")
    return found


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: all distinct splits for up to 6 classes, else a dense random code."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 6:
        splits = [s for s in itertools.product([1, -1], repeat=n) if s[0] == 1 and min(s) < 0]
        return np.array(splits, np.int8).T
    rng, best, gap = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(15 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min((int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(n), 2)), default=0)
        if apart > gap:
            best, gap = code, apart
    return best


class Model:
    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.5) -> None:
        self.languages = sorted(counts)
        self.code = codebook(len(self.languages)) if counts else np.zeros((0, 0), np.int8)
        p = [(counts[x] + smoothing) / (counts[x].sum(1, keepdims=True) + smoothing * BUCKETS) for x in self.languages]
        self.weights = np.zeros((self.code.shape[1], 2, BUCKETS + 1), np.float32)
        self.trust = np.ones(self.code.shape[1])
        for b in range(self.code.shape[1] if len(p) > 1 else 0):
            on = np.mean([x for x, c in zip(p, self.code[:, b], strict=True) if c > 0], 0)
            off = np.mean([x for x, c in zip(p, self.code[:, b], strict=True) if c < 0], 0)
            self.weights[b, :, :BUCKETS] = np.log(on / off)
            # expected margin of an n-gram under its own language, at the worst language: how far the bit can be trusted
            own = [c * (x * self.weights[b, :, :BUCKETS]).sum(1).mean() for x, c in zip(p, self.code[:, b], strict=True)]
            self.trust[b] = max(0.05, min(own))
        self.trust /= self.trust.sum() or 1.0

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text, one column per language, from loss-weighted decoding."""
        n = len(offsets) - 1
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        margins = np.zeros((n, self.code.shape[1]))
        if len(full):
            grams = features(raw, offsets)
            for b in range(self.code.shape[1]):
                for w, g in zip(self.weights[b], grams, strict=True):
                    margins[full, b] += np.add.reduceat(w[g], offsets[:-1][full])
        count = np.maximum(1, np.diff(offsets))[:, None]
        margins = np.clip(margins / 2 * np.minimum(1, EVIDENCE / count), -30, 30)
        loss = np.stack([np.logaddexp(0, -margins * c) @ self.trust for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


class _Kernel:
    def __init__(self, model, ratio: float) -> None:
        self.model, self.ratio = model, ratio

    def __call__(self, column: pa.Array) -> list:
        model, (raw, offsets) = self.model.value, _bytes.view(column)
        n = len(column)
        if not model.languages:
            return [["und"] * n, [0.0] * n, [None] * n, [False] * n]
        letters = has_letter(column, raw, offsets)
        p = model.probabilities(raw, offsets)
        order = np.argsort(-p, 1, kind="stable")
        rows = np.arange(n)
        top = p[rows, order[:, 0]]
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(n)
        names = np.array([*model.languages, "und"], object)
        first = np.where(letters, order[:, 0], len(model.languages))
        runner = [names[i] if ok else None for i, ok in zip(order[:, 1], letters, strict=True)] if p.shape[1] > 1 else [None] * n
        return [pa.array(names[first], pa.string()), np.where(letters, top, 0.0), runner, letters & (second >= self.ratio * top)]


def count_ngrams(labelled: DataFrame, text: str, label: str) -> dict[str, np.ndarray]:
    """Per label the counts of hashed n-grams over all its texts, summed on the executors."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for name, counts in held.items():
                where = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(where)), pa.array(where.astype(np.int32)), pa.array(counts[where])], names=["label", "bucket", "n"])
            held.clear()

        for batch in batches:
            for part in _bytes.slices(batch, "t"):
                raw, offsets = _bytes.view(part.column(0))
                grams = features(raw, offsets)
                for i, name in enumerate(part.column(1).to_pylist()):
                    counts = held.setdefault(name, np.zeros(2 * BUCKETS, np.int64))
                    a, b = offsets[i], offsets[i + 1]
                    for k, g in enumerate(grams):
                        counts[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(g[a:b], minlength=BUCKETS + 1)[:BUCKETS] if b - a > 20000 else 0
                        if b - a <= 20000:
                            own = g[a:b]
                            np.add.at(counts, own[own < BUCKETS] + k * BUCKETS, 1)
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).filter("t is not null and l is not null").mapInArrow(run, "label string, bucket int, n bigint")
    out: dict[str, np.ndarray] = {}
    summed = rows.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    for name, bucket, n in (tuple(r) for r in summed.groupBy("label").agg(F.collect_list("bucket"), F.collect_list("n")).toLocalIterator()):
        out.setdefault(name, np.zeros(2 * BUCKETS))[np.array(bucket)] = n
    return {k: v.reshape(2, BUCKETS) for k, v in out.items()}


def fit(labelled: DataFrame, *, text: str = "text", label: str = "lang") -> Model:
    return Model(count_ngrams(labelled, text, label))


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, ambiguous_at: float = 0.5) -> DataFrame:
    """Adds lang_pred, score (probability of the nearest codeword), runner_up and ambiguous (the
    runner-up has at least ``ambiguous_at`` times the winner's probability)."""
    return map_text(docs, text, docs.columns if keep is None else keep, RESULT, _Kernel(docs.sparkSession.sparkContext.broadcast(model), ambiguous_at))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")
