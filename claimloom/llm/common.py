"""What the training-data operators share: lineage cuts, bounded broadcasts, joins and components without hot tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 64 << 20
#: A key with more than one row in so many, and more than HOT_ROWS, is hot; there are at most HOT_SHARE hot keys.
HOT_SHARE = 1024
HOT_ROWS = 1000
#: Components of so many links at most are found by one task (16 bytes a link); more links take rounds over all executors.
ONE_TASK_LINKS = 2_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, one in the warehouse of a local master; a cluster must name it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/claimloom-cuts"


def cut(df: DataFrame) -> DataFrame:
    """Write df out and go on from the written copy, in the shared folder. Copies go when the application's folder goes (or by spark.cleaner.referenceTracking.cleanCheckpoints)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inner_name(*frames: DataFrame) -> str:
    """A start for column names that none of the frames' columns has."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = "_c"
    while any(c.startswith(name) for c in taken):
        name = f"_{uuid.uuid4().hex[:8]}"
    return name


def small_enough(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows, measured by row_bytes plus 64 each, are proven to fit the broadcast bound."""
    return (df.agg(F.sum(row_bytes.cast("long") + 64)).first()[0] or 0) <= limit


def join_values(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to values, which has one row for each key and in `count` how many rows have it (values is cut already).

    Hot keys (over a HOT_SHARE-th of all rows, so at most HOT_SHARE of them) are joined by broadcast; the rest by a shuffle in which
    no key is hot. So one key may hold any share of the rows. Null keys match nothing.
    """
    total, most = values.agg(F.sum(count), F.max(count)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= bound:
        return rows.join(values.drop(count), key)
    hot = F.broadcast(cut(values.where(F.col(count) > bound).drop(count)))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col(count) <= bound).drop(count), key)
    return rows.join(hot, key).unionByName(rest)


def _one_task(batches):
    """Components of all links by array passes: each node takes the least component of its neighbours, then its component's own."""
    import numpy as np
    import pyarrow as pa

    found = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    none = np.zeros(0, np.int64)
    u, v = (np.concatenate([none, *(f[i] for f in found)]) for i in range(2))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    comp = np.arange(len(nodes))
    while True:
        low = np.minimum(comp[a], comp[b])
        new = comp.copy()
        for x in (a, b, comp[a], comp[b]):  # also the roots, so that whole components join
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == comp).all():
            break
        comp = new
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[comp]})


def connected_components(edges: DataFrame, rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (a long, b long): component is the smallest node reachable.

    Few links (one_task at most, by default ONE_TASK_LINKS) go to one task. More take alternating large-star and small-star steps;
    each round is cut, and rounds grow with the logarithm of the diameter. Minima are partial aggregates, and the neighbours of a
    hub meet its minimum by a broadcast of hubs alone, so no task takes a hub whole.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    if pairs.count() <= (ONE_TASK_LINKS if one_task is None else one_task):
        return cut(pairs.coalesce(1).mapInArrow(_one_task, "node long, component long"))
    seen = None
    for _ in range(rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = cut(join_values(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every smaller neighbour of u, and u itself, goes to the least of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_values(large, least, "u", "n").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = cut(small.where("u > v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
