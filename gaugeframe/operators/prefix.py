"""Running sums and ranks over many rows without a window that outgrows a task.

Where a table is larger than a window may be (its rows are counted), rows fall into ordered buckets (by quantiles of the order column, or by leading hash digits). A
window runs inside each bucket; totals of the buckets before it, a few numbers per key, are added.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Rows (groups of equal values) up to which one window per key does; beyond, buckets.
WINDOW_ROWS = 1 << 22
_held: list[list[DataFrame]] = []
_own: dict[str, str] = {}


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Collects the tables that operators keep while a plan is built; ``free`` lets them go once the
    plan's results are read."""
    _held.append([])
    try:
        yield _held[-1]
    finally:
        _held.pop()


def _folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir; in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = _own.setdefault("folder", tempfile.mkdtemp(prefix="gaugeframe-kept-"))
    return found


def once(df: DataFrame) -> DataFrame:
    """A table that several steps of a plan read, written to the shared folder: it is computed once,
    outlives any executor, has a known size, and the plans above it stay small. Without a shared
    folder it is persisted instead."""
    spark = df.sparkSession
    folder = _folder(spark)
    if folder is None:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
    if _held:
        _held[-1].append(out)
    return out


def free(tables: list[DataFrame]) -> None:
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_kept_at", None)
        if spark.sparkContext._jsc is None:  # the session has ended
            continue
        if path is None:
            df.unpersist()
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def on(keys: list[str], left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on keys; a cross join with a one-row side if there are none."""
    return left.join(right, keys, how) if keys else left.crossJoin(F.broadcast(right))


def _search(order: str, low: int, high: int) -> str:
    """A binary search for a value's place among the cuts, as text: it stays inside codegen."""
    middle = (low + high) // 2
    return str(low) if low == high else f"case when _cuts[{middle}] < `{order}` then {_search(order, middle + 1, high)} else {_search(order, low, middle)} end"


def spread(df: DataFrame, wide: bool = True) -> tuple[DataFrame, bool]:
    """(the table, kept; whether its rows exceed what one window may hold). The count decides between
    two plans of equal results."""
    if not wide:
        return df, False
    df = df if df.is_cached or hasattr(df, "_kept_at") else once(df)
    return df, df.count() > WINDOW_ROWS


def with_buckets(df: DataFrame, keys: list[str], order: str, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Adds _b, a bucket number that ascends in the order asked for."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)]).alias("_cuts"))
    placed = on(keys, df, cuts)

    number = F.expr(_search(order, 0, buckets - 1))
    return placed.withColumn("_b", -number if descending else number).drop("_cuts")


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], descending: bool = False, ties: tuple[str, ...] = (), bucketed: bool = False, wide: bool = True) -> DataFrame:
    """Adds inclusive running sums {new column: summed column} in order of ``order`` within keys.

    Up to ``WINDOW_ROWS`` rows (counted first) one window per key does; a larger table's rows are
    spread over buckets. ``wide`` false says that the caller has counted already.
    """
    df, wide = spread(df, wide)
    if not wide:
        window = Window.partitionBy(*keys).orderBy(F.desc(order) if descending else F.asc(order), *ties).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[c for c in df.columns if c != "_b"], *[F.sum(c).over(window).alias(n) for n, c in sums.items()])
    placed = df if bucketed else with_buckets(df, keys, order, descending)
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc(order) if descending else F.asc(order), *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(totals, [*keys, "_b"])
    return joined.select(*[c for c in df.columns if c != "_b"], *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def hash_rank(df: DataFrame, keys: list[str], digest: str, name: str = "rank", ties: tuple[str, ...] = (), wide: bool = True) -> DataFrame:
    """Adds the 1-based rank by a hex digest; the buckets are its leading digits, even by design."""
    placed = df.withColumn("_b", F.substring(digest, 1, 2)).withColumn("_one", F.lit(1).cast("bigint"))
    out = running(placed, keys, digest, {name: "_one"}, ties=ties, bucketed=True, wide=wide)
    return out.drop("_one")


def rank_table(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, 1-based average rank): ties share the mean of their places."""
    blocks = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running(blocks, keys, value, {"_upto": "_n"})
    return upto.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the average rank of ``value``."""
    return df.join(rank_table(df, keys, value, name), [*keys, value])


def total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
