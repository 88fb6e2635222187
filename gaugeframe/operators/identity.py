"""Statement identities of base rows and their propagation to all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import lexer


def statement_identities(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` with name, statement_sha256 and error (why the source was refused; null if it was
    read). Lexing is Arrow-batched; a null text is an empty source."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_source"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for source_text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    rows.append((*lexer.statement_identity(source_text or ""), None))
                except lexer.LexError as e:
                    rows.append((None, None, str(e)))
            made = [pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keep, "name", "statement_sha256", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, name string, statement_sha256 string, error string")


def violations(rows: DataFrame, base: DataFrame, namespace: str = "statement") -> DataFrame:
    """(rule, key): refused base sources, groups with several statements, names with several
    statements, rows whose group has no base, and rows whose unit_id (if they have one) differs."""
    read = base.filter("error is null")
    parts = [
        base.filter("error is not null").select(F.lit("refused").alias("rule"), F.col("item_id").cast("string").alias("key")),
        base.filter("group_id is null or trim(group_id) = ''").select(F.lit("blank_group").alias("rule"), F.col("item_id").cast("string").alias("key")),
        read.groupBy("group_id").agg(F.count_distinct("statement_sha256").alias("n")).filter("n > 1").select(F.lit("group_statements").alias("rule"), F.col("group_id").alias("key")),
        read.groupBy("name").agg(F.count_distinct("statement_sha256").alias("n")).filter("n > 1").select(F.lit("name_statements").alias("rule"), F.col("name").alias("key")),
        rows.join(read.select("group_id").distinct(), "group_id", "left_anti").select(F.lit("no_base").alias("rule"), F.col("item_id").cast("string").alias("key")),
    ]
    if "unit_id" in rows.columns:
        found = propagated(rows.withColumnRenamed("unit_id", "_unit"), base, namespace)
        parts.append(found.filter(F.col("_unit") != F.col("unit_id")).select(F.lit("unit_conflict").alias("rule"), F.col("item_id").cast("string").alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def propagated(rows: DataFrame, base: DataFrame, namespace: str = "statement") -> DataFrame:
    """Rows with source_group, unit_id, name and statement_sha256 of their group's base; of several
    bases of one statement the smallest name wins."""
    chosen = base.filter("error is null").groupBy("group_id").agg(F.min(F.struct("name", "statement_sha256")).alias("_i"))
    kept = [c for c in rows.columns if c not in ("source_group", "unit_id", "name", "statement_sha256")]
    joined = rows.select(*kept).join(chosen, "group_id")
    return joined.select(*kept, F.col("group_id").alias("source_group"), F.concat(F.lit(f"{namespace}::"), F.col("_i.statement_sha256")).alias("unit_id"), "_i.name", "_i.statement_sha256")


def diagnostics(base: DataFrame) -> DataFrame:
    """One row: base rows, groups, distinct statements and names, and statements with several names."""
    read = base.filter("error is null")
    counts = base.agg(F.count("*").alias("n_base")).crossJoin(read.agg(F.count_distinct("group_id").alias("n_groups"), F.count_distinct("statement_sha256").alias("n_statements"), F.count_distinct("name").alias("n_names")))
    several = read.groupBy("statement_sha256").agg(F.count_distinct("name").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_aliased"))
    return counts.crossJoin(several)
