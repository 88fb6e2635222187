"""Spark helpers that the operators share: folds, row keys, shared storage, lookups without skew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of our own in local mode
    (tests); a cluster must name one that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gaugeframe-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage and outlives any executor.

    The write is one execution whose shuffle files nothing else needs, so they go at its end.
    ``discard`` removes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes stored tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000, how: str = "left") -> DataFrame:
    """big joined to small on keys without skew.

    ``small`` has one row per key; ``weight`` counts the key's rows in ``big``. Keys with at least
    total/share rows number at most ``share`` (their weights sum to no more than total), so those go
    by broadcast; rows of all other keys meet in a shuffle where none is frequent. Keys are digests
    and the like: a null key meets nothing.
    """
    least = max(1, -(-total // share))
    heavy = small.filter(F.col(weight) >= least).drop(weight)
    light = small.filter(F.col(weight) < least).drop(weight)
    values = [c for c in heavy.columns if c not in keys]
    marked = big.join(F.broadcast(heavy.select(*keys, *[F.col(c).alias(f"_h_{c}") for c in values], F.lit(True).alias("_heavy"))), keys, "left")
    hot = marked.filter("_heavy").select(*big.columns, *[F.col(f"_h_{c}").alias(c) for c in values])
    rest = marked.filter("_heavy is null").select(*big.columns).join(light, keys, how)
    return hot.unionByName(rest.select(*big.columns, *values))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root its smallest node.

    Each node keeps a parent no larger than itself. A round hooks roots of both ends to the smaller
    and then halves the depth of all chains; the edges whose ends have met are dropped. Each round's
    tables are written to the shared folder and those before go; nothing of them reaches the driver.
    """
    def shrink(live: DataFrame) -> DataFrame:
        return stored(live.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    live = shrink(edges.select("a", "b"))
    parents = None
    while not live.isEmpty():  # every round hooks each root that has a smaller neighbour
        hook = stored(live.groupBy("a").agg(F.min("b").alias("to"), F.lit(True).alias("moved")), "hooks")  # the parent is smaller: no cycles
        while True:  # pointer jumping until every chain is one step long
            up = hook.select(F.col("a").alias("to"), F.col("to").alias("_up"))
            jumped = stored(hook.select("a", "to").join(up, "to", "left").select("a", F.coalesce("_up", "to").alias("to"), F.col("_up").isNotNull().alias("moved")), "hooks")
            discard(hook)
            hook = jumped
            if hook.filter("moved").isEmpty():
                break
        own = hook.select(F.col("a").alias("node"), F.col("to").alias("root"))
        if parents is not None:
            moved = parents.join(hook.select(F.col("a").alias("root"), F.col("to").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            own = moved.unionByName(own)  # a hooked node was a root: not in parents yet
        before, parents = parents, stored(own, "parents")
        ends = hook.select(F.col("a").alias("_n"), F.col("to").alias("_t"))
        joined = live.join(ends.withColumnsRenamed({"_n": "a", "_t": "ra"}), "a", "left").join(ends.withColumnsRenamed({"_n": "b", "_t": "rb"}), "b", "left")
        after = shrink(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        discard(before, live, hook)
        live = after
    discard(live)
    if parents is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    roots = parents.select(F.col("root").alias("node"), "root").distinct()
    return parents.unionByName(roots)


def map_text(df: DataFrame, text: str, keep: list[str], result: str, kernel, most: int = 1 << 20) -> DataFrame:
    """Columns ``keep`` and those of ``result`` (a DDL schema), which kernel(text array) makes row by row.

    The kernel gets parts of at most ``most`` bytes (a longer text comes alone), so a task's memory
    does not grow with the batch. A result column takes the place of a kept one of the same name.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(result)
    keep = [c for c in keep if c not in made.names]
    source = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = StructType(source.schema.fields[:-1] + made.fields)

    def run(batches):
        import pyarrow as pa

        from gaugeframe.llm import _bytes

        _bytes.tidy()
        types = None
        for batch in batches:
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                types = [f.type for f in to_arrow_schema(made)]
            for part in _bytes.slices(batch, "_text", most):
                made_columns = kernel(part.column(part.num_columns - 1))
                cast = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(made_columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cast], names=schema.names)
        _bytes.tidy()

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *made.names)
