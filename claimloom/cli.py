"""Command line: python -m claimloom.cli verify | graph | bench."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import evaluate, graph
from claimloom.sources import io

RESULT = ("claim", "status", "decision", "confidence", "support_score", "contradiction_score", "evidence_coverage", "excerpt", "signals", "reason")
GRAPH = ("claim", "support_score", "contradiction_score", "evidence_coverage", "nodes", "edges")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimloom")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("verify", "graph"):
        c = commands.add_parser(name)
        c.add_argument("--claim")
        c.add_argument("--claim-file")
        c.add_argument("--evidence")
        c.add_argument("--evidence-file")
        if name == "verify":
            c.add_argument("--include-graph", action="store_true")
    c = commands.add_parser("bench")
    c.add_argument("path")
    c.add_argument("--limit", type=int, default=0)
    return p


def as_json(df: DataFrame) -> str:
    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), indent=2)


def bench(cases: DataFrame, limit: int = 0) -> DataFrame:
    """Decisions on benchmark cases (claim, evidence, expected) against what is expected, the first `limit` in the file's order unless that is 0."""
    pairs = cases.withColumn("id", F.monotonically_increasing_id())  # one JSON file is read in one piece, in its order
    return evaluate.benchmark_summary(graph.verify(pairs.orderBy("id").limit(limit) if limit > 0 else pairs))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").appName("claimloom").getOrCreate()
    if args.command == "bench":
        print(as_json(bench(io.load_cases(spark, args.path), args.limit)))
        return 0
    try:
        claim, evidence = (io.text_of(getattr(args, n), spark, getattr(args, f"{n}_file")) for n in ("claim", "evidence"))
    except ValueError as e:
        print(f"claimloom: {e}", file=sys.stderr)
        return 2
    out = graph.verify(spark.createDataFrame([("0", claim, evidence)], "id string, claim string, evidence string"))
    columns = GRAPH if args.command == "graph" else (*RESULT, *(("nodes", "edges") if args.include_graph else ()))
    print(as_json(out.select(*columns)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
