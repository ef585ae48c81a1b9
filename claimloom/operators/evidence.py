"""Evidence windows: two sentences each, scored against a claim, the best few kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T

LIMIT = 3


def scores(hits: Column, claim_size: Column, window_size: Column) -> tuple[Column, Column]:
    """(coverage, overlap) of a window with so many hits."""
    coverage = hits / F.greatest(claim_size, F.lit(1))
    density = hits / F.greatest(window_size, F.lit(1))
    return coverage, T.clamp01(coverage * 0.78 + F.least(density * 3, F.lit(1.0)) * 0.22)


def best_places(claim_set: Column, sets: Column, limit: int = LIMIT, most: int | None = None) -> Column:
    """array<struct<less, position, coverage>> of the best windows; less is the overlap's negative. With most, windows begin at so many sentences only. Null for no windows."""
    none = F.array().cast("array<string>")

    def scored(met: Column, claim_size: Column) -> Column:
        def one(own: Column, i: Column) -> Column:
            after = F.coalesce(F.get(sets, i + 1), none)
            both = F.size(own) + F.size(after) - F.size(F.array_intersect(own, after))
            hits = F.size(F.array_union(F.get(met, i), F.coalesce(F.get(met, i + 1), none)))
            coverage, overlap = scores(hits, claim_size, both)
            return F.struct((-overlap).alias("less"), i.alias("position"), coverage.alias("coverage"))

        return F.transform(sets if most is None else F.slice(sets, 1, most), one)

    some = F.when(F.size(claim_set) > 0, sets).otherwise(F.slice(sets, 1, 0))
    return T.let(F.transform(some, lambda s: F.array_intersect(s, claim_set)), lambda met: F.when(F.size(met) > 0, F.slice(F.array_sort(scored(met, F.size(claim_set))), 1, limit)))


def best_windows(claim_set: Column, sentences: Column, sets: Column, limit: int = LIMIT, clip=lambda t: T.shorten(t, 700)) -> Column:
    """array<struct<text, overlap, coverage, position>>, best first, the earlier of equals first; empty for a claim without
    tokens. claim_set and sets (one for each sentence) are distinct tokens, made once a claim and once a source; sentences have
    single white space. Row by row, so it runs on streams and needs no shuffle.
    """
    kept = best_places(claim_set, sets, limit)
    text = lambda w: clip(F.concat_ws(" ", F.get(sentences, w["position"]), F.get(sentences, w["position"] + 1)))
    found = F.transform(kept, lambda w: F.struct(text(w).alias("text"), (-w["less"]).alias("overlap"), w["coverage"].alias("coverage"), w["position"].alias("position")))
    return F.coalesce(found, F.array().cast("array<struct<text:string,overlap:double,coverage:double,position:int>>"))


#: Sentences of a source that one row holds.
BLOCK = 256


def blocks(text: Column, size: int = BLOCK) -> Column:
    """array<struct<first, sets>>: the distinct tokens of a text's sentences in blocks, each with the sentence after it, so that no window is cut."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(size)), lambda a: F.struct(a.alias("first"), F.slice(s, a + 1, size + 1).alias("sets")))
    return T.let(T.token_sets(T.split_sentences(F.coalesce(text, F.lit("")))), lambda s: F.when(F.size(s) > 0, cut(s)))


def windows_long(pairs: DataFrame, limit: int = LIMIT, size: int = BLOCK) -> DataFrame:
    """The same as rows (id, rank, position, coverage, overlap), for sources too long for one row: a claim meets its source in blocks.

    Of each block a claim's best windows go on alone, without texts, so what is shuffled grows with claims and blocks, not with windows.
    """
    rows = pairs.select("id", T.token_set(F.coalesce("claim", F.lit(""))).alias("ct"), F.explode_outer(blocks(F.col("evidence"), size)).alias("b"))
    return _best_of_blocks(rows, limit, size)


def windows_long_against(claims: DataFrame, sources: DataFrame, on: str, limit: int = LIMIT, size: int = BLOCK) -> DataFrame:
    """windows_long of claims (id, on, claim) against sources (on, evidence), each source read once, however many claims name it."""
    met = sources.select(on, F.explode_outer(blocks(F.col("evidence"), size)).alias("b"))
    return _best_of_blocks(claims.select("id", on, T.token_set(F.coalesce("claim", F.lit(""))).alias("ct")).join(met, on), limit, size)


def _best_of_blocks(rows: DataFrame, limit: int, size: int) -> DataFrame:
    # outer: else a filter on the array is inferred, pushed below and computes all of it again
    w = rows.select("id", F.col("b.first").alias("first"), F.explode_outer(best_places(F.col("ct"), F.col("b.sets"), limit, size)).alias("w")).where("w is not null")
    w = w.select("id", (F.col("first") + F.col("w.position")).alias("position"), F.col("w.coverage").alias("coverage"), (-F.col("w.less")).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("overlap").desc(), "position"))
    return w.withColumn("rank", rank).where(F.col("rank") <= limit)
