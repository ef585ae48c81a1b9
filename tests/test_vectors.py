"""Vector search against brute force."""

import numpy as np
import pytest

from claimloom.operators import vectors
from claimloom.plans import queries


def test_cosine_argmax_sees_whole_labels(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    v = np.array(e["embedding"].tolist(), np.float64)
    sims = v @ v.T / np.outer(*[np.linalg.norm(v, axis=1)] * 2)
    label, ids = e["label"].to_numpy(), e["vec_id"].to_numpy()
    want = {}
    for i in range(len(e)):
        before = np.flatnonzero(label == label[i] - 1)
        if len(before):
            best = sims[i, before].max()
            want[ids[i]] = min(ids[before[sims[i, before] >= best - 1e-12]]), best
    got = {r.vec_id: (r.best, r.sim) for r in queries.cosine_argmax(spark, "/root/testdata/sf0.001").collect()}
    assert {k: b for k, (b, _) in got.items()} == {k: b for k, (b, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


@pytest.mark.parametrize("block", [2, 1000])
def test_blocks_equal_best_alignment(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(40)] + [(0, 40, [0.0] * 4), (1, 41, None), (9, 42, [1.0] * 4)]
    df = spark.createDataFrame(rows, "case int, pos long, vec array<double>")
    source = df.where("case != 9")
    want = sorted(map(tuple, vectors.best_alignment(df, source).collect()))
    assert sorted(map(tuple, vectors.best_in_blocks(df, source, block).collect())) == want
