"""Evaluation aggregates. A run row is (label 1/0, pred 1/0, decided, score, ...); 0 is the positive class of precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opaque(df: DataFrame) -> DataFrame:
    """df behind a generator of one row, through which no filter is pushed: what stands below is computed once however often it is asked about."""
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def exact_sum(x: Column, places: int) -> Column:
    """A rounded sum of doubles that does not depend on their order: added as decimals, halves go away from zero."""
    return F.round(F.sum(x.cast("decimal(28,15)")), places).cast("double")


def core_metrics(df: DataFrame, *by: str, label: str = "label", pred: str = "pred", more: tuple[Column, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, balanced accuracy, accuracy, precision, recall, f1, false accept and reject rates, by groups; more: other aggregates of the same pass."""
    y, p = F.col(label), F.col(pred)
    df = df.groupBy(*by).agg(*more, F.count_if((y == 0) & (p == 0)).alias("tp"), F.count_if((y == 1) & (p == 0)).alias("fp"), F.count_if((y == 0) & (p == 1)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "far": ratio(fn, tp + fn), "frr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    return df.withColumns({"balanced_accuracy": (F.col("recall") + ratio(tn, tn + fp)) / 2, "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))})


def abstention_views(df: DataFrame, *by: str) -> DataFrame:
    """Metrics of decided rows, of all with undecided accepted, and of all with undecided escalated, with the share that is decided; one scan."""
    views = df.select("*", F.explode(F.array(*map(F.lit, ("decided", "accept", "escalate")))).alias("view"))
    filled = F.when(F.col("decided"), F.col("pred")).when(F.col("view") == "accept", 1).when(F.col("view") == "escalate", 0)
    views = views.withColumn("pred", filled)  # null, so in no cell, where an undecided row does not count
    more = (F.avg(F.col("decided").cast("double")).alias("coverage"), F.count("*").alias("n_total"), F.count_if("decided").alias("n_decided"))
    metrics = core_metrics(views, *by, "view", more=more)
    last = ("coverage", "n_total", "n_decided")
    return metrics.select(*[c for c in metrics.columns if c not in last], *last)


UNDECIDED = ("UNVERIFIABLE", "UNREACHABLE", "UNCITED")


def prediction_analysis(df: DataFrame, *by: str) -> DataFrame:
    """(predicted, expected) as metrics with abstention rate and the accuracy of what was decided. Undecided predictions are in no cell.

    The false accept rate is over unsupported cases; it is 0 where no decided case is or was told supported.
    """
    told = ~F.col("predicted").isin(*UNDECIDED)
    side = lambda c: F.when(told, (F.col(c) == "SUPPORTED").cast("int"))
    rows = df.withColumns({"_label": side("expected"), "_pred": side("predicted"), "_open": (~told).cast("double")})
    metrics = core_metrics(rows.withColumnsRenamed({"_label": "label", "_pred": "pred"}), *by)
    open_ = rows.groupBy(*by).agg(F.avg("_open").alias("abstention_rate"), F.count("*").alias("n"))
    both = metrics.join(open_, list(by)) if by else metrics.crossJoin(open_)  # one row each
    far = F.when((F.col("fn") + F.col("tn") > 0) & (F.col("fn") + F.col("tp") > 0), F.col("far")).otherwise(0.0)
    return both.withColumns({"far": far, "coverage_conditioned_accuracy": F.col("accuracy")})


def prediction_sweep(df: DataFrame, steps: int = 20) -> DataFrame:
    """(threshold, tp.., precision, recall, f1, far, frr): a case is flagged where it is told unsupported with at least that confidence (null: .5)."""
    rows = df.where(~F.col("predicted").isin(*UNDECIDED))
    rows = rows.select((F.col("expected") == "SUPPORTED").cast("int").alias("label"), F.col("predicted"), F.coalesce("confidence", F.lit(0.5)).alias("c"), F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("threshold"))
    flagged = (F.col("predicted") == "UNSUPPORTED") & (F.col("c") >= F.col("threshold"))
    return core_metrics(rows.withColumn("pred", (~flagged).cast("int")), "threshold")


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """core_metrics at each threshold (pred 1 from it on): each row meets each threshold in the map, sums cross the shuffle."""
    rows = df.select(F.col(label).alias("label"), F.col(score).alias("score"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return core_metrics(rows.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int")), "threshold")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold of the highest balanced accuracy."""
    return sweep.agg(F.max_by("threshold", F.struct("balanced_accuracy", -F.col("threshold"))).alias("threshold"), F.max("balanced_accuracy").alias("balanced_accuracy"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of (confidence, correct): bins [i/n, (i+1)/n), so 1.0 is in none but counted; null is 0.5."""
    c = F.coalesce("confidence", F.lit(0.5))
    at = F.coalesce(*[F.when((c >= i / bins) & (c < (i + 1) / bins), i) for i in range(bins)])
    per = df.select(c.alias("c"), F.col("correct").cast("double").alias("k"), at.alias("bin")).groupBy("bin").agg(F.avg("c").alias("conf"), F.avg("k").alias("acc"), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("acc")) * F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("ece"), F.sum("n").alias("scored"))


def benchmark_summary(df: DataFrame) -> DataFrame:
    """Decisions against expected SUPPORTED / UNSUPPORTED, with false accept and reject rates."""
    s, d = F.col("expected") == "SUPPORTED", F.col("decision")
    n = {f"{side}_{name}": F.count_if(cond & dec) for side, cond in (("supported", s), ("unsupported", ~s)) for name, dec in (("accepted", d == "ACCEPT"), ("rejected", d == "REJECT"), ("routed", ~d.isin("ACCEPT", "REJECT")))}
    out = df.agg(F.count("*").alias("total"), *[c.alias(k) for k, c in n.items()], F.count_if(s).alias("supported"), F.count_if(~s).alias("unsupported"))
    return out.withColumns({"false_accept_rate": F.col("unsupported_accepted") / F.greatest("unsupported", F.lit(1)), "false_reject_rate": F.col("supported_rejected") / F.greatest("supported", F.lit(1))})


def per_signal(df: DataFrame) -> DataFrame:
    """(name, fires, correct, incorrect): signals that take a side, against `expected`."""
    # outer: else a filter on the array is pushed below and computes all signals again
    x = df.select("expected", F.explode_outer("signals").alias("s")).where("s.verdict in ('SUPPORT', 'CONTRADICT')")
    ok = (F.col("s.verdict") == "SUPPORT") == (F.col("expected") == "SUPPORTED")
    return x.groupBy(F.col("s.name").alias("name")).agg(F.count("*").alias("fires"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, (mid - half) / den).otherwise(0.0), F.when(n > 0, (mid + half) / den).otherwise(0.0)


def same_ids(first: DataFrame, second: DataFrame) -> bool:
    """Whether both have the same ids, each as often. Runs a job."""
    mark = lambda df, n: df.select("id", F.lit(n).alias("n"))
    return mark(first, 1).unionByName(mark(second, -1)).groupBy("id").agg(F.sum("n").alias("n")).where("n != 0").isEmpty()


def compose_tiers(first: DataFrame, second: DataFrame, check: bool = True) -> DataFrame:
    """first's decided rows, and second's for the rest, by id. With check, different ids raise at once (which runs a job over the ids)."""
    if check and not same_ids(first, second):
        raise ValueError("the tiers do not have the same ids")
    both = first.alias("a").join(second.alias("b"), "id")
    return both.select("id", F.when(F.col("a.decided"), F.col("a.pred")).otherwise(F.col("b.pred")).alias("pred"), F.when(F.col("a.decided"), "tier1").otherwise("tier2").alias("tier"))


def resume(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select("id").distinct(), "id", "left_anti")
