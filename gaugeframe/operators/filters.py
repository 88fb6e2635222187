"""Selections, exclusions and set checks over scored rows and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.splits import top_per_parent


def select_rows(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every value that is given (None: any); an empty result raises."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    if df.isEmpty():
        raise ValueError(f"no row with {equal}")
    return df


def is_root(kind: Column) -> Column:
    return kind != "variant"


def is_counter_root(kind: Column, source_kind: Column) -> Column:
    """A root whose kind, or whose kind at the source, is counter."""
    return is_root(kind) & ((kind == "counter") | F.coalesce(source_kind == "counter", F.lit(False)))


def fit_mask(kind: Column, alias: Column, eligible: Column) -> tuple[Column, Column]:
    """(rows a probe may be fitted on, conflict of kind and alias): roots, counters only if eligible."""
    one = F.coalesce(kind, alias)
    return (one != "variant") & ((one != "counter") | F.coalesce(eligible, F.lit(False))), kind.isNotNull() & alias.isNotNull() & (kind != alias)


def defensible(df: DataFrame, kind: str = "kind", eligible: str = "eligible") -> tuple[DataFrame, DataFrame]:
    """(rows that were not generated, or are eligible; one row with retained and dropped)."""
    keep = (F.col(kind) == "root") | F.coalesce(F.col(eligible), F.lit(False))
    return df.filter(keep), df.agg(F.count_if(keep).alias("retained"), F.count_if(~keep).alias("dropped"))


def exclude_units(df: DataFrame, excluded: DataFrame, unit: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose unit is not excluded; rows and dropped rows per source file).

    Both come from one left join with the distinct excluded units.
    """
    gone = excluded.select(F.col(unit)).distinct().withColumn("_gone", F.lit(True))
    marked = df.join(gone, unit, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    counts = marked.groupBy(*([source] if source else [])).agg(F.count("*").alias("n_rows"), F.count_if("_gone").alias("n_dropped"))
    return marked.filter(~F.col("_gone")).drop("_gone"), counts


def pooled(column: str, *tables: DataFrame) -> DataFrame:
    """Distinct values of a column over several tables."""
    out = tables[0].select(column)
    for t in tables[1:]:
        out = out.unionByName(t.select(column))
    return out.distinct()


def stacked(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not found (unknown ledger keys, families without scores)."""
    return wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one of two tables holds."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def subtree(rows: DataFrame, seed: int, drop_variants: tuple[str, ...] = (), drop_counters: tuple[str, ...] = (), per_root: int | None = None, per_positive: int | None = None) -> DataFrame:
    """Rows (item_id, kind, parent_id, positive_id, edit) without named families of counters and
    variants, with the first counters per positive and variants per parent in hash order; variants
    of a dropped counter go with it."""
    named = lambda names: F.coalesce(F.col("edit").isin(*names), F.lit(False)) if names else F.lit(False)
    roots, counters = rows.filter("kind = 'root'"), rows.filter("kind = 'counter'").filter(~named(drop_counters))
    if per_positive is not None:
        free = counters.filter("positive_id is null")
        counters = top_per_parent(counters.filter("positive_id is not null"), "positive_id", "item_id", per_positive, seed, "ablation-counter").unionByName(free)
    kept = roots.unionByName(counters)
    variants = rows.filter("kind = 'variant'").filter(~named(drop_variants)).join(kept.select(F.col("item_id").alias("parent_id")), "parent_id", "left_semi")
    if per_root is not None:
        variants = top_per_parent(variants, "parent_id", "item_id", per_root, seed, "ablation-variant")
    return kept.unionByName(variants.select(*rows.columns))


def before_checking(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows still to be checked: none of a unit in which some check timed out (dropped before the
    expensive step) and none whose content hash has an answer; one row per content hash."""
    timed_out = evidence.filter("returncode is null").select("target_hash")
    units = rows.join(timed_out, "target_hash", "left_semi").select("unit_id").distinct()
    done = evidence.filter("returncode is not null").select("target_hash").distinct()
    left = rows.join(units, "unit_id", "left_anti").join(done, "target_hash", "left_anti")
    return left.groupBy("target_hash").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_rows"))


def pair_membership(pairs: DataFrame) -> DataFrame:
    """item_id and the sorted pair ids it takes part in, from (pair_id, positive_id, negative_id)."""
    ends = pairs.select("pair_id", F.explode(F.array("positive_id", "negative_id")).alias("item_id")).filter("item_id is not null")
    return ends.groupBy("item_id").agg(F.sort_array(F.collect_set("pair_id")).alias("pair_ids"))


def tail(text: Column, most: int) -> Column:
    """The last characters of a log."""
    return F.when(F.length(text) > most, F.right(text, F.lit(most))).otherwise(text)


def first_jobs(jobs: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n jobs in order; all for None."""
    ordered = jobs.orderBy(*order)
    return ordered if n is None else ordered.limit(n)
