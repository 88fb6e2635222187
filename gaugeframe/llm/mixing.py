"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: every source gets a share of the total by weight, stops at ``cap`` times its size, and the
excess is shared again by weight until no source is above. Seats are blocks of equal token counts:
sources get theirs by highest quotients target / (2 seats + 1), then each source's seats go to its
shards in the same way. Inside a shard the documents stand in seeded order and are cut into blocks;
whole repeats of the shard come first, and a seeded choice of blocks supplies the rest.

Only per-source and per-shard sums reach the driver: ``most_sources`` and ``most_shards`` bound
them, and more sources than that raise. A shard holds a hash range of one source, so a hot source
is spread over many; rows carry sizes, not texts.

Defined cases: a null text has size 0; empty documents take 0; the null source is a source of its
own, last in order; a source without words has target 0; no rows give no rows; rows repeated exactly
are separate documents in ``plan`` and share their takings equally (rounded down) in ``mix``. Sizes,
seats and choices depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _bytes
from gaugeframe.llm._spark import stored, table, text_digest

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fill(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Shares of total by weight, none above cap times its size; the excess is shared again."""
    targets, left, open_ = [0.0] * len(sizes), float(total), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] >= cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = level * weights[i]
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients w/1, w/3, w/5, ...; ties go to the earlier entry."""
    whole = sum(weights)
    if whole <= 0 or seats <= 0:
        return [0] * len(weights)
    got = [int(w / whole * seats + 0.5) for w in weights]  # near the end; the quotients settle the rest
    up = [(-w / (2 * q + 1), i) for i, (w, q) in enumerate(zip(weights, got, strict=True)) if w > 0]
    down = [(w / (2 * q - 1), -i) for i, (w, q) in enumerate(zip(weights, got, strict=True)) if q > 0]
    heapq.heapify(up)
    heapq.heapify(down)
    while (gap := seats - sum(got)) > 0:
        for _ in range(gap):
            _, i = heapq.heappop(up)
            got[i] += 1
            heapq.heappush(up, (-weights[i] / (2 * got[i] + 1), i))
    while (gap := sum(got) - seats) > 0:
        for _ in range(gap):
            _, i = heapq.heappop(down)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(down, (weights[-i] / (2 * got[-i] - 1), i))
    return got


def choose(sizes: np.ndarray, goal: int, block: int, seed: int) -> np.ndarray:
    """Tokens taken of each document: documents in order form one stream, cut into blocks; whole
    repeats first, then blocks in seeded order until the goal is met (the last one in part)."""
    ends = np.cumsum(sizes)
    whole = int(ends[-1]) if len(sizes) else 0
    if whole == 0:
        return np.zeros(len(sizes), np.int64)
    repeats, rest = divmod(min(goal, 2 * whole), whole)
    n = -(-whole // block)
    lengths = np.full(n, block, np.int64)
    lengths[-1] = whole - block * (n - 1)
    order = np.argsort(_bytes.mix(np.arange(n, dtype=np.uint64) + np.uint64(seed % (1 << 64))), kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    used = np.zeros(n, np.int64)
    used[order] = np.clip(rest - before, 0, lengths[order])
    upto = np.concatenate([[0], np.cumsum(used)])

    def taken(t):
        b = np.minimum(t // block, n - 1)
        return upto[b] + np.minimum(t - b * block, used[b])

    return repeats * sizes + taken(ends) - taken(ends - sizes)


def plan(rows: DataFrame, *, key: list[str], source: str = "source", size: str = "size", weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, cap: float = 2.0, block_tokens: int = 256, rows_per_shard: int = 256, most_shards: int = 1 << 16, most_sources: int = 100_000, seed: int = 20) -> DataFrame:
    """Rows of ``key``, source and size with source_size, target (of its source) and taken."""
    # sizes are read three times (sources, shards, choice) and counted once
    rows = stored(rows.select(*key, F.col(f"`{source}`").alias("_source"), F.col(f"`{size}`").cast("bigint").alias("_size")), "sizes")
    found = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("rows")).orderBy(F.col("_source").asc_nulls_last()).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [int(r["size"]) for r in found]
    total = sum(sizes)
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(found))], factor * total, cap)
    block = max(1, min(block_tokens, min((s for s in sizes if s), default=64) // 64))
    seats = sainte_lague(targets, round(sum(targets) / block))
    width = max(rows_per_shard, -(-sum(r["rows"] for r in found) // most_shards))
    spark = rows.sparkSession
    facts = spark.createDataFrame([(i, r["_source"], s, t, max(1, -(-r["rows"] // width))) for i, (r, s, t) in enumerate(zip(found, sizes, targets, strict=True))], "_s int, _name string, source_size bigint, target double, _shards int")
    # at most most_sources rows: a proven bound for the broadcast
    dealt = rows.join(F.broadcast(facts), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    ordered = F.xxhash64(F.lit(seed), *key)
    dealt = dealt.withColumn("_order", ordered).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.col("_shards")).cast("int"))
    shards = dealt.groupBy("_s", "_shard").agg(F.sum("_size").alias("size")).orderBy("_s", "_shard").collect()  # at most most_shards + most_sources
    goals = []
    by: dict[int, list] = {}
    for r in shards:
        by.setdefault(r["_s"], []).append(r)
    for s, own in by.items():
        for r, q in zip(own, sainte_lague([float(r["size"]) for r in own], seats[s]), strict=True):
            goals.append((s, r["_shard"], min(q * block, int(cap * r["size"]))))
    goal = spark.createDataFrame(goals, "_s int, _shard int, _goal bigint")
    dealt = dealt.join(F.broadcast(goal), ["_s", "_shard"])
    names = [*key, "_source", "_size", "source_size", "target", "taken"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*names[:-1]).schema) + ", taken bigint"

    def run(pdf):
        import pandas as pd  # noqa: F401

        pdf = pdf.sort_values(["_order", *key], kind="stable")
        pdf["taken"] = choose(pdf["_size"].to_numpy(np.int64), int(pdf["_goal"].iloc[0]), block, seed * 1_000_003 + int(pdf["_s"].iloc[0]) * 65_537 + int(pdf["_shard"].iloc[0]))
        return pdf[names]

    out = dealt.groupBy("_s", "_shard").applyInPandas(run, schema)
    return out.select(*key, F.col("_source").alias(source), F.col("_size").alias(size), "source_size", "target", "taken")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents with size, source_size, target and taken (columns of these names give way; all
    others stay, whatever their names)."""
    made = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], text_digest(F.col(f"`{text}`")).alias("_gf_text"))
    entries = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col("_gf_text").alias("_text"), F.col(f"`{source}`").alias("_from"), words_in(F.col(f"`{text}`")).alias("size")).groupBy("_id", "_text", "_from").agg(F.max("size").alias("size"), F.count("*").alias("_n"))
    planned = plan(entries.withColumn("size", F.col("size") * F.col("_n")), key=["_id", "_text", "_n"], source="_from", **options)
    planned = planned.select(F.col("_id").alias("_gf_i"), F.col("_text").alias("_gf_t"), F.col("_from").alias("_gf_f"), (F.col("size") / F.col("_n")).cast("bigint").alias("size"), "source_size", "target", F.expr("taken div _n").alias("taken"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_gf_i")) & (F.col("_gf_text") == F.col("_gf_t")) & F.col(f"`{source}`").eqNullSafe(F.col("_gf_f"))
    return docs.join(planned, same, "left").select(*[F.col(f"`{c}`") for c in kept], *made)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    return plan(sized, key=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
