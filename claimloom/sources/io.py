"""Sources and sinks. Schemas are stated, never inferred."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "claim string, url string, expected string, evidence string, category string"
PAIR = "id string, claim string, evidence string, label int, dataset string"
RUN = "id string, dataset string, label int, pred int, score double, decided boolean, signal string, tier string, latency_ms double"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path, multiLine=True)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).parquet(path)


def as_pairs(rows: DataFrame, split: str, order: str, limit: int = 0) -> DataFrame:
    """rows (claim, doc, label, dataset, order) of a benchmark's split as pairs, id `split-n` by place in order; the first `limit` of them unless that is 0.

    order is the source's own row number, so ids do not depend on partitions.
    """
    out = rows.select(F.concat(F.lit(f"{split}-"), F.col(order).cast("string")).alias("id"), "claim", F.col("doc").alias("evidence"), F.col("label").cast("int").alias("label"), "dataset", F.col(order).alias("_n"))
    return (out.orderBy("_n").limit(limit) if limit else out).drop("_n")


def snapshot(pairs: DataFrame, path: str) -> None:
    """Written once: a snapshot that is there stays."""
    pairs.write.mode("ignore").parquet(path)


def text_of(value: str | None, spark: SparkSession | None = None, path: str | None = None) -> str:
    """A text given inline, else a file's; it is an error to give neither."""
    if value is not None:
        return value
    if path is None:
        raise ValueError("give a text or a file")
    return read_text(spark, path).first()["text"]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an earlier run; broken lines are dropped."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path)


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def dataset_hash(pairs: DataFrame, order: str) -> str:
    """The first 16 hexadecimal digits of SHA-256 over id, claim and label of each pair in order (null: empty).

    A hash over a sequence has no parallel form: rows come to the driver one partition at a time and are not kept.
    """
    h = hashlib.sha256()
    text = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "claim", "label")])
    for r in pairs.select(order, text.alias("t")).orderBy(order).toLocalIterator(prefetchPartitions=True):
        h.update(r.t.encode())
    return h.hexdigest()[:16]


def dataset_digest(pairs: DataFrame) -> DataFrame:
    """(dataset, n, hash): an order-free digest, the sum of row digests, for tables too large for dataset_hash."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "claim", F.col("label").cast("string")), 256), 1, 12), 16, 10).cast("long")
    return pairs.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 40))).alias("hash"))


def export_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Benchmark cases (id, claim, url, expected, category) with a result (id, predicted, confidence, tier, signals), signals without their texts; cases without one are left out."""
    slim = F.transform("signals", lambda s: F.struct(s["name"].alias("name"), s["verdict"].alias("verdict"), s["score"].alias("score"), s["weight"].alias("weight")))
    both = cases.join(results, "id")
    return both.select("id", "claim", "url", "expected", "predicted", "confidence", "tier", slim.alias("signals"), "category")


def sample_documents(docs: DataFrame, n: int, seed: str, low: int = 500, high: int = 3000) -> DataFrame:
    """n distinct texts of medium length, in the order of a seeded hash."""
    x = docs.where((F.length("text") > low) & (F.length("text") < high)).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return x.withColumn("o", F.sha2(F.concat(F.lit(seed), F.col("text")), 256)).orderBy("o", "doc_id").limit(n).select("doc_id", "text")
