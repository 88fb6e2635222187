"""Live certificates (an extension): score events against a frozen state, and windowed abstention.

A stream-static join with the one-row state; late events are dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.conformal import decision


def decide(events: DataFrame, state: DataFrame, score: str = "value") -> DataFrame:
    """Adds the certificate decision; works on streaming and on static events."""
    joined = events.crossJoin(F.broadcast(state.select("orientation", "threshold", "q")))  # the state is one row
    turned = F.col(score) * F.col("orientation")
    return joined.withColumn("decision", decision(turned, F.col("threshold"), F.col("q"))).drop("orientation", "threshold", "q")


def abstention_by_window(events: DataFrame, state: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    decided = decide(events, state).withWatermark(time, delay)
    return decided.groupBy(F.window(time, width)).agg(F.avg((F.col("decision") == "abstain").cast("double")).alias("abstention"), F.count("*").alias("n"))
