"""Mixing, top-k, induced sorting, components, and the pipeline on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import mixing, topk
from gaugeframe.llm._spark import components, lookup
from gaugeframe.llm.induced_sort import suffix_order


def test_fill_and_apportionment():
    targets = mixing.fill([100, 10, 0, 50], [3, 1, 2, 3], 240, 2.0)
    assert targets[1] == 20 and targets[2] == 0 and sum(targets) == pytest.approx(240) and targets[0] == pytest.approx(120) and targets[3] == 100
    rng = random.Random(1)
    for _ in range(50):
        w = [rng.random() for _ in range(rng.randint(1, 8))]
        seats, want = rng.randint(0, 40), [0] * len(w)
        for _ in range(seats):
            want[max(range(len(w)), key=lambda i: w[i] / (2 * want[i] + 1))] += 1
        assert mixing.sainte_lague(w, seats) == want


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "b", "c", None]) if i > 3 else "tiny", 1.0) for i in range(400)] + [(400, None, "a", 1.0), (401, "", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double")
    sized = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    out = mixing.plan(sized, key=["doc_id"]).collect()
    again = mixing.plan(sized.repartition(7), key=["doc_id"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 402
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(256, 0.02 * own[0].target) and own[0].source_size == sum(r["size"] for r in own)
    mixed = mixing.mix(docs)
    assert mixed.count() == 402 and mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=5).round(2)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, None]), (304, [float("nan")] * 5), (None, [1.0]), (306, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block_rows=16, tile_blocks=3).collect()
    valid = {i: np.floor(64 * np.pad(np.array(v, float), (0, 5 - len(v)))).astype(int) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()}
    want = {(q, r + 1): (c, s) for q in valid if q % 20 == 0 for r, (s, c) in enumerate(sorted(((int(valid[q] @ valid[c]), c) for c in valid if c != q), key=lambda x: (-x[0], x[1]))[:7])}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in out} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id <= 3"), F.col("vec_id") == 0, k=7).count() == 3


def test_top_k_refuses_what_a_score_cannot_hold(spark):
    df = spark.createDataFrame([(i, [1e300 if i == 3 else 1.0]) for i in range(6)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(df, F.col("vec_id") == 0).collect()
    wide = spark.createDataFrame([(i, [float(i) * 1e6]) for i in range(6)], "vec_id bigint, embedding array<double>")
    out = topk.top_k(wide, F.col("vec_id") == 5, k=2, block_rows=2, tile_blocks=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(4, 5 * 4 * 64 * 64 * 10**12), (3, 5 * 3 * 64 * 64 * 10**12)]


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * i, "a" if i % 2 else None, "mine", 7) for i in range(20)], "doc_id bigint, text string, source string, _text string, _id int")
    out = mixing.mix(docs)
    assert out.columns[:5] == docs.columns and out.filter("_text = 'mine' and _id = 7").count() == 20


def brute_mix(rows, targets, block, seed, rows_per_shard):
    """Takings by direct simulation: seats by highest quotient, blocks in seeded order."""
    from gaugeframe.llm import _bytes

    sizes = [sum(s for _, k, s, *_ in rows if k == i) for i in range(len(targets))]
    def seats_of(weights, n):
        got = [0] * len(weights)
        for _ in range(n if sum(weights) > 0 else 0):
            got[max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
        return got
    seats, taken = seats_of(targets, round(sum(targets) / block)), {}
    for i in range(len(targets)):
        shards = sorted({sh for _, k, _, sh, _ in rows if k == i})
        content = [sorted((o, d, s) for d, k, s, sh, o in rows if k == i and sh == x) for x in shards]
        for x, own, q in zip(shards, content, seats_of([float(sum(s for *_, s in c)) for c in content], seats[i]), strict=True):
            stream = [d for _, d, s in own for _ in range(s)]
            goal = min(q * block, 2 * len(stream))
            times = {d: 0 for _, d, _ in own}
            if stream:
                for d in stream * (goal // len(stream)):
                    times[d] += 1
                rest, n = goal % len(stream), -(-len(stream) // block)
                order = np.argsort(_bytes.mix(np.arange(n, dtype=np.uint64) + np.uint64((seed * 1_000_003 + i * 65_537 + x) % (1 << 64))), kind="stable")
                for d in [stream[t] for b in order for t in range(b * block, min(len(stream), (b + 1) * block))][:rest]:
                    times[d] += 1
            taken |= times
    return taken


def test_mixing_matches_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 60)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    got = {r.doc_id: r for r in mixing.plan(df, key=["doc_id"], rows_per_shard=20).collect()}
    names = ["a", "b", None]
    totals = [sum(s for _, x, s in rows if x == n) for n in names]
    targets = mixing.fill(totals, [3, 1, 2], 1.5 * sum(totals))
    block = max(1, min(256, min(totals) // 64))
    placed = df.withColumn("o", F.xxhash64(F.lit(20), "doc_id")).withColumn("h", F.xxhash64(F.lit(21), "doc_id")).collect()
    shards = [max(1, -(-sum(1 for _, x, _ in rows if x == n) // 20)) for n in names]
    flat = [(r.doc_id, names.index(r.source), r["size"], r.h % shards[names.index(r.source)], r.o) for r in placed]
    want = brute_mix(flat, targets, block, 20, 20)
    assert {i: r.taken for i, r in got.items()} == want


def test_induced_sort_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(120):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 50)).tolist()
        order, common = suffix_order(t, cap=1000, memory=int(rng.choice([1, 10**6])), internal=int(rng.choice([0, 10**6])))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        lcp = [0] + [next((k for k in range(len(t)) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or not t[a + k : a + k + 1]), 0) for a, b in zip(want, want[1:], strict=False)]
        assert order.tolist() == want and common.tolist() == lcp


def test_components_and_lookup(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v int")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    assert lookup(big, small, ["k"], "n", 300, share=10).groupBy().agg(F.count("*"), F.sum("m")).first()[0] == 300


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
    assert 0.8 * before < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
