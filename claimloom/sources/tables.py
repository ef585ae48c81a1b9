"""Results as files: a run's summary and manifest, and tables for papers. Each is made of an aggregate of few rows."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADLINE = ("System", "BAcc", "95% CI", "FAR", "FRR", "Coverage", "ms/claim", "Params invoked")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any file system that Spark knows, replaced if it is there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def summary_json(summary: DataFrame) -> str:
    """A one-row frame as indented JSON."""
    return json.dumps(json.loads(summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]), indent=2)


def write_run(spark: SparkSession, folder: str, system: str, rows: DataFrame, summary: DataFrame, dataset: str, commit: str = "unknown", when: str | None = None) -> None:
    """A run's rows as JSON lines, its summary, and a manifest of where it comes from."""
    rows.write.mode("errorifexists").json(f"{folder}/{system}.jsonl")
    write_text(spark, f"{folder}/{system}.summary.json", summary_json(summary))
    when = when or datetime.datetime.now(datetime.UTC).isoformat()
    write_text(spark, f"{folder}/{system}.manifest.json", json.dumps({"system": system, "commit": commit, "dataset_hash": dataset, "timestamp": when}, indent=2))


def _one(share: Column) -> Column:
    """A share in percent with one digit, halves to even; nan for none."""
    return F.when(share.isNotNull(), F.format_string("%.1f", F.bround(share * 100, 1))).otherwise("nan")


def headline_rows(summaries: DataFrame) -> DataFrame:
    """summaries (system, bacc, low, high, far, frr, coverage, ms_per_claim, params) as cells of the headline table."""
    ci = F.concat(F.lit("["), _one(F.col("low")), F.lit(", "), _one(F.col("high")), F.lit("]"))
    cells = ("system", _one(F.col("bacc")), ci, _one(F.col("far")), _one(F.col("frr")), _one(F.col("coverage")), F.format_string("%.2f", F.bround("ms_per_claim", 2)), F.format_string("%,.0f", F.col("params").cast("double")))
    return summaries.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(cells)])


def breakdown_rows(metrics: DataFrame, systems: list[str]) -> DataFrame:
    """metrics (dataset, system, balanced_accuracy) as a row a dataset and a column a system, by dataset."""
    wide = metrics.groupBy("dataset").pivot("system", systems).agg(F.first("balanced_accuracy"))
    return wide.orderBy("dataset").select("dataset", *[_one(F.col(s)).alias(s) for s in systems])


def markdown(header, rows: list) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |\n"
    return line(header) + "|" + "---|" * len(header) + "\n" + "".join(map(line, rows))


def latex(header, rows: list) -> str:
    line = lambda cells: " & ".join(map(str, cells)) + " \\\\\n"
    return "\\begin{tabular}{l" + "r" * (len(header) - 1) + "}\n\\toprule\n" + line([h.replace("%", "\\%") for h in header]) + "\\midrule\n" + "".join(map(line, rows)) + "\\bottomrule\n\\end{tabular}\n"


def write_table(spark: SparkSession, folder: str, name: str, header, rows: DataFrame) -> None:
    """A table of few rows as Markdown and LaTeX."""
    cells = [tuple(r) for r in rows.collect()]  # as many as the table has lines
    write_text(spark, f"{folder}/{name}.md", markdown(header, cells))
    write_text(spark, f"{folder}/{name}.tex", latex(header, cells))


def union_summaries(*summaries: DataFrame | None) -> DataFrame:
    """The summaries that exist, one below another."""
    there = [s for s in summaries if s is not None]
    out = there[0]
    for s in there[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
