"""Verification on streams: the batch projection unchanged, and answer gates over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import gate, graph, signals


def verify_stream(pairs: DataFrame, rules=signals.DEFAULT_RULES) -> DataFrame:
    return graph.verify(pairs, rules)


def gate_stream(decisions: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """decisions (ts, answer_id, decision) to a gate per answer and window; rows later than the watermark are dropped."""
    return decisions.withWatermark("ts", watermark).groupBy(F.window("ts", window), "answer_id").agg(gate.aggregate(F.col("decision")).alias("gate"))


def fresh(pairs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each id once within the watermark: the streaming form of skipping done ids."""
    return pairs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])
