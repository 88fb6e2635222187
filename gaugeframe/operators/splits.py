"""Group-aware splits and hash-ordered samples; no draw depends on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import stable_hex, unit_interval_split
from gaugeframe.operators.prefix import hash_rank, on


def exact_split(df: DataFrame, unit: str, seed: int, namespace: str = "unit-split", wide: bool = True) -> DataFrame:
    """(unit, split): exact 60/20/20 of the distinct units by hash rank, left-over seats by largest
    remainder in the order train, calibration, test."""
    units = df.select(unit).distinct().withColumn("_h", stable_hex(namespace, seed, F.col(unit)))
    n = units.agg(F.count("*").alias("_n"))
    ranked = on([], hash_rank(units, [], "_h", "_rank", (unit,), wide=wide), n)
    # largest remainder of (.6, .2, .2) n: fractions of fifths, so only n mod 5 decides
    base_train, base_cal = F.floor(F.col("_n") * 3 / F.lit(5)), F.floor(F.col("_n") / 5)
    r5 = F.col("_n") % 5
    # n=1: .6/.2/.2 -> train; n=2: 1.2/.4/.4 -> 1,1,0 (calibration first); n=3: 1.8/.6/.6 -> 2,1,0; n=4: 2.4/.8/.8 -> 2,1,1
    train = base_train + F.when(r5.isin(1, 3), 1).otherwise(0)
    cal = base_cal + F.when(r5.isin(2, 3, 4), 1).otherwise(0)
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + cal, "calibration").otherwise("test")
    return ranked.select(unit, split.alias("split"))


def threshold_split(df: DataFrame, unit: str, seed: int, namespace: str = "interval-split") -> DataFrame:
    """(unit, split) by the hash's place in the unit interval: population-invariant, shares approximate."""
    return df.select(unit).distinct().withColumn("split", unit_interval_split(stable_hex(namespace, seed, F.col(unit))))


def round_robin_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int, namespace: str = "sample") -> DataFrame:
    """n rows, seats dealt in turn over the sorted strata; hash order inside each."""
    digest = df.withColumn("_h", stable_hex(namespace, seed, F.col(key)))
    ranked = hash_rank(digest, [stratum], "_h", "_r", (key,)).filter(F.col("_r") <= n)  # a stratum never gets more than n
    return ranked.orderBy("_r", stratum).limit(n).drop("_h", "_r")


def proportional_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int, namespace: str = "proportional-sample", tie_namespace: str = "stratum-tie") -> DataFrame:
    """n rows with largest-remainder seats per stratum; all rows if there are no more than n."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    every = Window.partitionBy()  # one row per stratum
    quota = F.lit(n) * F.col("_size") / F.sum("_size").over(every)
    seats = sizes.withColumn("_seat", F.floor(quota)).withColumn("_frac", quota - F.floor(quota)).withColumn("_all", F.sum("_size").over(every))
    order = Window.orderBy(F.desc("_frac"), stable_hex(tie_namespace, seed, F.col(stratum)), stratum)
    seats = seats.withColumn("_seats", F.when(F.col("_all") <= n, F.col("_size")).otherwise(F.col("_seat") + F.when(F.row_number().over(order) <= n - F.sum("_seat").over(every), 1).otherwise(0)))
    ranked = hash_rank(df.withColumn("_h", stable_hex(namespace, seed, F.col(key))), [stratum], "_h", "_r", (key,))
    return ranked.join(F.broadcast(seats.select(stratum, "_seats")), stratum).filter(F.col("_r") <= F.col("_seats")).drop("_h", "_r", "_seats")


def top_per_parent(df: DataFrame, parent: str, key: str, k: int, seed: int, namespace: str) -> DataFrame:
    """First k rows of each parent by (hash, key)."""
    order = Window.partitionBy(parent).orderBy(stable_hex(namespace, seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def pack_groups(df: DataFrame, group: str, budget: int, seed: int, namespace: str = "group-pack") -> DataFrame:
    """Groups taken whole in hash order while they fit the row budget; one that does not is skipped.

    Whether a group fits depends on all before it: the group counts pass one task in order, as a
    stream (sorted with spilling, constant memory).
    """
    counts = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", stable_hex(namespace, seed, F.col(group)))

    def fold(batches):
        used = 0
        for batch in batches:
            kept = []
            for n in batch.column(1).to_pylist():
                kept.append(used + n <= budget)
                used += n if kept[-1] else 0
            import pyarrow as pa

            yield batch.select([0]).filter(pa.array(kept, pa.bool_()))

    kind = df.schema[group].dataType.simpleString()
    ordered = counts.repartition(1).sortWithinPartitions("_h", group).select(group, "n")
    return ordered.mapInArrow(fold, f"`{group}` {kind}").select(F.col(group).cast("string").alias(group))


def greedy_batches(df: DataFrame, key: list[str], order: str, length: str, budget: int, most: int) -> DataFrame:
    """Adds batch: neighbours in order share one until (longest length x size) or size would exceed
    its limit. Sequential within each key, so each key is folded on its own."""
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, length))).alias("_x"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("m"), F.array().cast("array<int>").alias("out"))

    def step(acc: F.Column, x: F.Column):
        longest = F.greatest(acc["m"], x[length].cast("bigint"))
        new = (acc["n"] > 0) & ((longest * (acc["n"] + 1) > budget) | (acc["n"] + 1 > most))
        b = acc["b"] + F.when(new, 1).otherwise(0)
        return F.struct(b.alias("b"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, x[length].cast("bigint")).otherwise(longest).alias("m"), F.concat(acc["out"], F.array(b)).alias("out"))

    folded = rows.withColumn("_o", F.aggregate("_x", start, step)["out"])
    return folded.select(*key, F.posexplode("_x").alias("_i", "_e"), "_o").select(*key, F.col("_e")[order].alias(order), F.col("_e")[length].alias(length), F.get("_o", F.col("_i")).alias("batch"))
