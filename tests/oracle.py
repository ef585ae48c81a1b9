"""Compare queries with their SQL: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v != v else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df[cols].astype(object).itertuples(index=False)), key=str)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path / '*.parquet' if path.is_dir() else path}'")
    mine, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    return "" if a == b else f"{len(a)} and {len(b)} rows; {[x for x in zip(a, b, strict=False) if x[0] != x[1]][:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sqls:
        began = time.time()
        try:
            said = compare(spark, name, queries[name], sqls[name], sys.argv[1])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, round(time.time() - began, 1), said or "equal", flush=True)
