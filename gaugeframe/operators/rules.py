"""Validation as data: a rule set gives a table of violations; ``require`` raises on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every row that breaks a rule; the expressions are true where broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def row_rules() -> dict[str, Column]:
    """Rules of a protocol row: ids, labels, finite scores, kind and links that fit together."""
    c = F.col
    blank = lambda n: c(n).isNull() | (F.trim(n) == "")
    return {
        "blank_item": blank("item_id"),
        "blank_unit": blank("unit_id"),
        "label": ~c("label").isin(-1, 0, 1) | c("label").isNull(),
        "score": c("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")),
        "kind": ~c("kind").isin("root", "variant", "counter") | c("kind").isNull(),
        "variant_link": (c("kind") == "variant") != c("parent_id").isNotNull(),
        "positive_link": c("positive_id").isNotNull() & (c("kind") != "counter"),
    }


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def not_functional(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def tree_violations(rows: DataFrame) -> DataFrame:
    """Child-to-parent checks: orphans, and children that differ from their root."""
    child = rows.filter("kind = 'variant'").alias("c")
    root = rows.filter("kind <> 'variant'").alias("r")
    joined = child.join(root, F.col("c.parent_id") == F.col("r.item_id"), "left")
    rules = {
        "orphan": F.col("r.item_id").isNull(),
        "unit": F.col("c.unit_id") != F.col("r.unit_id"),
        "label": ~F.col("c.label").eqNullSafe(F.col("r.label")) & F.col("r.item_id").isNotNull(),
        "eligible": F.col("c.eligible") & ~F.col("r.eligible"),
    }
    broken = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in rules.items()]))
    return joined.select(F.explode(broken).alias("rule"), F.col("c.item_id").alias("key"))


class Violation(ValueError):
    pass


def require(found: DataFrame, what: str) -> None:
    """Raises if there is a violation; only the first one reaches the driver."""
    if (row := found.first()) is not None:
        raise Violation(f"{what}: {row.asDict()}")
