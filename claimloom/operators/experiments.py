"""Experiments over runs: what a run records of each case, tiers, resampling, ablation, cost and generation rates.

A run row is (id, dataset, label 1/0, pred 1/0, decided, score, signal, tier, latency_ms).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T

from . import evaluate as V
from . import graph
from . import signals as S

#: Parameters that a model's call costs, and the model that a tiered system's second tier calls.
PARAMS = {"signals": 0, "nli": 184_000_000, "minicheck": 783_000_000, "tafs": 22_700_000}
SECOND_TIER = {"tiered": "nli", "tiered_tafs": "tafs", "tiered_minicheck": "minicheck"}


def top_signal(signals: Column) -> Column:
    """The name of the highest signal among contradictions, if there are any, else among all; the first of equals; null for none."""
    against = F.filter(signals, lambda s: s["verdict"] == "CONTRADICT")

    def best(xs: Column) -> Column:
        most = F.array_max(F.transform(xs, lambda s: s["score"]))
        return F.get(F.filter(xs, lambda s: s["score"] == most), F.lit(0))["name"]

    return T.let(F.when(F.size(against) > 0, against).otherwise(signals), best)


def run_rows(verified: DataFrame) -> DataFrame:
    """verified results as run rows: only supported and unsupported ones are decided."""
    return verified.withColumns({"decided": F.col("status").isin("SUPPORTED", "UNSUPPORTED"), "pred": (F.col("status") == "SUPPORTED").cast("int"), "score": F.col("support_score"), "signal": top_signal(F.col("signals"))})


def limited(cases: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n cases in order; all of them for n of 0."""
    return cases.orderBy(*order).limit(n) if n > 0 else cases


def escalated(runs: DataFrame, n: int, order: str) -> DataFrame:
    """The first n undecided cases in order."""
    return limited(runs.where("not decided"), n, order)


def of_ids(pairs: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return pairs.join(ids.select(id), id, "left_semi")


def last_written(rows: DataFrame, id: str, order: str) -> DataFrame:
    """Of rows with one id, the one written last."""
    nth = F.row_number().over(Window.partitionBy(id).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def rebuilt(pairs: DataFrame, rows: DataFrame, id: str, order: str) -> DataFrame:
    """A resumed run in the order of its pairs: each pair with its last row; pairs without one are left out."""
    return pairs.join(last_written(rows, id, order).drop(order), id)


def with_results(cases: DataFrame, results: DataFrame, id: str = "id") -> DataFrame:
    """Every case, with its result where there is one, and whether there is."""
    return cases.join(results, id, "left").withColumn("done", F.col("predicted").isNotNull())


VIEWS = ("all", "correct", "wrong", "unverifiable", "unreachable")


def view(results: DataFrame, name: str, page: int = 0, size: int = 50, order: str = "id") -> DataFrame:
    """One page of the results that a view shows, in order; an unknown view is an error."""
    p, e = F.col("predicted"), F.col("expected")
    told = p.isin("SUPPORTED", "UNSUPPORTED")
    keep = {"all": F.lit(True), "correct": p == e, "wrong": told & (p != e), "unverifiable": p == "UNVERIFIABLE", "unreachable": p == "UNREACHABLE"}[name]
    return results.where(keep).orderBy(order).offset(page * size).limit(size)


def ranked_signals(signals: Column, most: int = 6) -> Column:
    """Signals by score times weight, the first of equals first."""
    keyed = F.transform(signals, lambda s, i: F.struct((-(s["score"] * s["weight"])).alias("less"), i.alias("at"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["s"])


def token_chunks(text: Column, size: int = 400, step: int = 200, least: int = 50) -> Column:
    """A text's words in overlapping chunks; a short last chunk is left out if there is another, and none begins once the end is met."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda a: (a == 0) | ((a + (size - step) < n) & (n - a >= least)))
        return F.when(n > size, F.transform(starts, lambda a: F.array_join(F.slice(words, a + 1, size), " "))).otherwise(F.array(text))

    words = F.filter(F.split(text, rf"{T.SPACE}+"), lambda w: w != "")
    return T.let(words, cut)


def bootstrap_ci(runs: DataFrame, *by: str, metric: str = "balanced_accuracy", resamples: int = 1000, seed: int = 42, label: str = "label", pred: str = "pred") -> DataFrame:
    """(by, n, low, high): the 95 % interval of a metric over resamples of the rows.

    The metric depends on tp, fp, fn and tn alone, and these four are multinomial in a resample; so one pass counts them and
    each group's replicates are drawn from its counts, however many rows there are. Groups are drawn from the seed and their counts.
    """
    cells = V.core_metrics(runs, *by, label=label, pred=pred).select(*by, "tp", "fp", "fn", "tn")
    kinds = dict(cells.dtypes)

    def draw(batches):
        import numpy as np

        for t in batches:
            out = []
            for row in t[["tp", "fp", "fn", "tn"]].to_numpy(np.int64):
                n = int(row.sum())
                tp, fp, fn, tn = np.random.default_rng(seed).multinomial(n, row / max(n, 1), resamples).T.astype(float) if n else np.zeros((4, resamples))
                over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
                precision, recall = over(tp, tp + fp), over(tp, tp + fn)
                of = {"balanced_accuracy": (recall + over(tn, tn + fp)) / 2, "accuracy": over(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": over(2 * precision * recall, precision + recall), "far": over(fn, tp + fn), "frr": over(fp, fp + tn)}[metric]
                out.append((n, *np.percentile(of, [2.5, 97.5])))
            yield pd.concat([t[list(by)].reset_index(drop=True), pd.DataFrame(out, columns=["n", "low", "high"]).astype({"n": "int64"})], axis=1)

    return cells.mapInPandas(draw, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "n long, low double, high double"]))


def per_dataset(runs: DataFrame, default: int = 1) -> DataFrame:
    """core_metrics of each dataset, and of all (null), with undecided cases counted as default."""
    filled = runs.withColumn("pred", F.when(F.col("decided"), F.col("pred")).otherwise(default))
    both = filled.select("dataset", "label", "pred").unionByName(filled.select(F.lit(None).cast("string").alias("dataset"), "label", "pred"))
    return V.core_metrics(both, "dataset")


def cost_summary(runs: DataFrame) -> DataFrame:
    """One row a system of (system, latency_ms, tier): mean, middle (the upper one of two) and per-thousand latency, and parameters called a claim."""
    sizes = {r[0]: r[1] for r in runs.groupBy("system").agg(F.count("latency_ms")).collect()}  # one row a system
    # the middle is an exact order statistic: at place n // 2 of n - 1 steps
    middle = F.coalesce(*[F.percentile(F.when(F.col("system") == s, F.col("latency_ms")), (n // 2) / max(n - 1, 1) if n > 1 else 0.0) for s, n in sizes.items()], F.lit(0.0))
    second = F.coalesce(*[F.when(F.col("system") == s, F.lit(m)) for s, m in SECOND_TIER.items()])
    params = lambda name: F.coalesce(*[F.when(name == m, F.lit(p)) for m, p in PARAMS.items()], F.lit(0))
    called = F.when(second.isNotNull(), F.when(F.col("tier") == second, params(second)).otherwise(0)).otherwise(params(F.col("system")))
    out = runs.withColumn("_p", called).groupBy("system").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("ms_per_claim_mean"), middle.alias("ms_per_claim_p50"), F.avg("_p").alias("param_invocations_per_claim"))
    return out.withColumn("ms_per_1k_claims", F.col("ms_per_claim_mean") * 1000)


def ablation(pairs: DataFrame, rules=S.DEFAULT_RULES) -> DataFrame:
    """(variant, view, metrics, n, coverage): the engine with all rules and without each. Signals are made once; each variant leaves its rule's out.

    pairs (id, claim, evidence, label).
    """
    return V.abstention_views(without_each(graph.with_signals(graph.prepare(pairs), rules), rules), "variant")


def without_each(ready: DataFrame, rules=S.DEFAULT_RULES) -> DataFrame:
    """(variant, label, pred, decided) of rows with signals and label, with all rules and without each.

    The graph is built once: what a rule adds to it are its signal's edges, which a variant leaves out.
    """
    built = graph.build_graph(ready).select("label", "evidence_coverage", "signals", "edges")

    both = lambda support, against: F.struct(support.alias("support"), against.alias("contradiction"))

    def without(rule: str) -> Column:
        left = F.filter("signals", lambda s: s["name"] != rule)
        edges = F.filter("edges", lambda e: ~F.startswith(e["source"], F.lit(f"signal:{rule.lower()}:")))
        return T.let(left, lambda x: both(*graph.edge_scores(edges, S.support_score(x), S.contradiction_score(x))))

    scored = built.select("label", "evidence_coverage", F.explode(F.array(*[F.struct(F.lit(r).alias("variant"), without(r).alias("s")) for r in ("full", *rules)])).alias("v"))
    scored = scored.select("v.variant", "label", graph.decision(F.col("v.s.contradiction"), F.col("evidence_coverage"), F.col("v.s.support")).alias("d"))
    return scored.select("variant", "label", (F.col("d") == "ACCEPT").cast("int").alias("pred"), F.col("d").isin("ACCEPT", "REJECT").alias("decided"))


def signal_accuracy(runs: DataFrame, kept: tuple[str, ...] = S.DEFAULT_RULES) -> DataFrame:
    """(signal, correct, total, accuracy, kept) of decided cases by the signal that decided.

    Conditions stand in the aggregate: a filter on what a run computes, or on a key, would be pushed below it and compute it again.
    """
    named = F.col("decided") & F.col("signal").isNotNull()
    out = runs.groupBy("signal").agg(F.count_if(F.col("decided") & (F.col("pred") == F.col("label"))).alias("correct"), F.count_if(named).alias("total"))
    return out.where("total > 0").withColumns({"accuracy": F.col("correct") / F.col("total"), "kept": F.col("signal").isin(*kept)})


def rejecting_precision(runs: DataFrame) -> DataFrame:
    """(signal, n, precision): of the decided cases that a signal flags, the share that is unsupported."""
    flagged = F.col("decided") & (F.col("pred") == 0)
    out = runs.groupBy("signal").agg(F.count_if(flagged).alias("n"), F.avg(F.when(flagged, (F.col("label") == 0).cast("double"))).alias("precision"))
    return out.where("n > 0")


def hallucination_rates(rows: DataFrame) -> DataFrame:
    """(condition, claims, unsupported, rate, regenerations, blocked, caught) of generated answers."""
    out = rows.groupBy("condition").agg(*[F.sum(c).alias(c) for c in ("claims", "unsupported", "regenerations")], F.sum(F.col("blocked").cast("long")).alias("blocked"), F.sum("caught").alias("caught"))
    return out.withColumn("rate", V.ratio(F.col("unsupported"), F.col("claims")))


def tier_shares(runs: DataFrame) -> DataFrame:
    """(tier, n, share)."""
    out = runs.groupBy("tier").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
