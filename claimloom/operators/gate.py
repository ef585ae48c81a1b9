"""From claim decisions to one decision per answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(decision: Column) -> Column:
    """An aggregate: a REJECT rejects; over a quarter unresolved abstains; all ACCEPT accepts; else REVISE."""
    n = F.count(decision)
    open_ = F.count_if(decision.isin("ABSTAIN", "REVISE"))
    return F.when(n == 0, "ABSTAIN").when(F.count_if(decision == "REJECT") > 0, "REJECT").when(open_ / n > 0.25, "ABSTAIN").when(F.count_if(decision == "ACCEPT") == n, "ACCEPT").otherwise("REVISE")


def gate(answers: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, gate) for every answer; one without decisions abstains. A null key is a key as any other."""
    found = decisions.groupBy(F.col(key).alias("_of")).agg(aggregate(F.col("decision")).alias("gate"))
    return answers.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("_of")), "left").select(key, F.coalesce("gate", F.lit("ABSTAIN")).alias("gate"))
