"""Graphs as tensors: feature rows of nodes, edge positions, message passing, and an adapter's forward pass with given weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: The place of each kind's mark in a feature row.
KIND_OFFSETS = {"claim": 0, "source": 7, "evidence": 14, "entity": 21, "quantity": 28, "relation": 35, "signal": 42, "gate": 49}


def hash_bucket(text: Column, buckets: int) -> Column:
    """The first 32 bits of a text's SHA-256, modulo buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def feature_rows(nodes: Column, support: Column, contradiction: Column, size: int = 64) -> Column:
    """array<array<double>>: for each node 1 at its kind, .5 more at its label's bucket, and at the end its score, the graph's support and contradiction. A graph without nodes has one row of zeros."""
    kind = F.create_map(*[x for k, v in KIND_OFFSETS.items() for x in (F.lit(k), F.lit(v % size))])
    places = F.array(*[F.lit(i) for i in range(size - 3)])

    def row(n: Column) -> Column:
        def placed(x: Column) -> Column:  # kind and bucket are found once a node, not once a place
            at = lambda i: (i == x["kind"]).cast("double") + F.when(i == x["bucket"], 0.5).otherwise(0.0)
            return F.concat(F.transform(places, at), F.array(n["score"], support, contradiction))

        return T.let(F.struct(kind[n["kind"]].alias("kind"), hash_bucket(n["label"], size).alias("bucket")), placed)

    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), size), 1)
    return F.when(F.size(nodes) > 0, F.transform(nodes, row)).otherwise(zeros)


def place_sums(features: DataFrame, size: int = 64) -> DataFrame:
    """(place, x, n): sums over all rows of feature_rows in column f, and how many rows there are; one row of partial sums a task goes on, not one a place of a node."""
    rows = features.select(F.explode_outer("f").alias("row"))
    sums = rows.agg(F.array(*[F.sum(F.get("row", F.lit(i))) for i in range(size)]).alias("x"), F.count("row").alias("n")).where("n > 0")
    return sums.select(F.posexplode("x").alias("place", "x"), "n")


def edge_index(nodes: Column, edges: Column) -> Column:
    """array<struct<src, dst, weight>>: edges by their nodes' places; edges to nodes that are not there are dropped."""
    ids = F.transform(nodes, lambda n: n["id"])
    placed = F.transform(edges, lambda e: F.struct((F.array_position(ids, e["source"]) - 1).cast("int").alias("src"), (F.array_position(ids, e["target"]) - 1).cast("int").alias("dst"), e["weight"].alias("weight")))
    return F.filter(placed, lambda e: (e["src"] >= 0) & (e["dst"] >= 0))


def message_pass(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (case, pos, vec) after one step: each node's sum over its incoming edges (case, src, dst, weight) of weight times the source's vector.

    Nodes without incoming edges get zeros; those of a case without any edges the mean of its nodes. Sums are partial aggregates by place.
    """
    size = F.size("vec")
    parts = edges.join(nodes.select("case", F.col("pos").alias("src"), "vec"), ["case", "src"]).select("case", F.col("dst").alias("pos"), F.posexplode(F.transform("vec", lambda x: x * F.col("weight"))).alias("i", "x"))
    sums = parts.groupBy("case", "pos", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("case", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("message"))  # one vector's components
    mean = nodes.join(edges.select("case").distinct(), "case", "left_anti").select("case", F.posexplode("vec").alias("i", "x")).groupBy("case", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    out = nodes.join(sums, ["case", "pos"], "left").join(mean, "case", "left")
    return out.select("case", "pos", F.coalesce("message", "mean", F.array_repeat(F.lit(0.0), size)).alias("message"))


def adapter(cases: DataFrame, weights: dict, steps: int = 2) -> DataFrame:
    """cases (id, hidden, features, edges) with adapted (the decoder's vector moved along the graph's context) and risk.

    hidden: array<double>; features and edges as feature_rows and edge_index give them. weights: numpy arrays node_w, node_b, norm_w, norm_b,
    message_w, message_b, gate_w, gate_b, risk_w, risk_b (rows are outputs), which the caller brings; none come with the package.
    """
    kind = dict(cases.dtypes)["id"]

    def run(batches):
        import numpy as np

        def norm(x):
            return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)

        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        w = {k: np.asarray(v, np.float64) for k, v in weights.items()}
        for t in batches:
            out = []
            for hidden, features, edges in zip(t["hidden"], t["features"], t["edges"], strict=True):
                x = np.array([list(f) for f in features], np.float64) @ w["node_w"].T + w["node_b"]
                state = norm(x * sigmoid(x)) * w["norm_w"] + w["norm_b"]
                for _ in range(steps):
                    if len(edges):
                        sent = np.zeros_like(state)
                        for e in edges:
                            sent[e["dst"]] += state[e["src"]] * e["weight"]
                    else:
                        sent = np.repeat(state.mean(0, keepdims=True), len(state), 0)
                    state = norm(state + sent @ w["message_w"].T + w["message_b"])
                context = state.mean(0)
                gate = sigmoid(context @ w["gate_w"].T + w["gate_b"])
                out.append((np.asarray(list(hidden), np.float64) + gate * context, float(sigmoid(context @ np.ravel(w["risk_w"]) + float(np.ravel(w["risk_b"])[0])))))
            yield pd.DataFrame({"id": t["id"], "adapted": [o[0] for o in out], "risk": [o[1] for o in out]})

    return cases.select("id", "hidden", "features", "edges").mapInPandas(run, f"id {kind}, adapted array<double>, risk double")
