"""Registration of queries with their SQL; numbers are rounded to six decimals on both sides."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.prefix import free, scope

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            with scope() as held:
                out = rounded(f(spark, sf_dir))
            weakref.finalize(out, free, held)  # what the plan keeps goes with its result
            return out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
