"""Vector operators: cosine, token alignment, monotone pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def best_alignment(claim: DataFrame, source: DataFrame) -> DataFrame:
    """claim and source are (case, pos, vec): for each claim token the source position of highest cosine in its own case, the first of equals."""
    pairs = claim.alias("c").join(source.alias("s"), F.col("c.case") == F.col("s.case"))
    sim = pairs.select(F.col("c.case").alias("case"), F.col("c.pos").alias("pos"), F.col("s.pos").alias("at"), cosine(F.col("c.vec"), F.col("s.vec")).alias("sim"))
    return sim.groupBy("case", "pos").agg(F.max_by("at", F.struct("sim", -F.col("at"))).alias("best"), F.max("sim").alias("sim"))


def best_in_blocks(claim: DataFrame, source: DataFrame, block: int = 2000) -> DataFrame:
    """best_alignment of vectors of one length, null ones as zeros: every pair of a case is compared, by matrix products of blocks of about so many rows."""
    most = source.groupBy("case").count().agg(F.max("count")).first()[0] or 0
    many = claim.groupBy("case").count().agg(F.max("count")).first()[0] or 0
    down, across = max(1, -(-many // block)), max(1, -(-most // block))

    def best(c, s):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            rows = t.column("vec").to_pylist()
            size = max((len(v) for v in rows if v is not None), default=0)
            return np.array([v if v is not None else [0.0] * size for v in rows], np.float64).reshape(len(rows), size)

        def exact(x, y):  # summed in the order of dot()
            out = np.zeros(len(x))
            for k in range(x.shape[1]):
                out += x[:, k] * y[:, k]
            return out

        if not c.num_rows or not s.num_rows:
            return pa.table({"case": c.column("case").slice(0, 0), "pos": c.column("pos").slice(0, 0), "best": s.column("pos").slice(0, 0), "sim": pa.array([], pa.float64())})
        x, y, at = matrix(c), matrix(s), s.column("pos").to_numpy()
        width = max(x.shape[1], y.shape[1])
        x, y = (m if m.shape[1] else np.zeros((len(m), width)) for m in (x, y))
        nx, ny = np.sqrt(exact(x, x)), np.sqrt(exact(y, y))
        ux, uy = (m / np.where(n > 0, n, 1)[:, None] for m, n in ((x, nx), (y, ny)))
        near = ux @ uy.T
        i, j = np.nonzero(near >= near.max(axis=1, keepdims=True) - 1e-9)  # the best but for rounding, and its equals
        n = nx[i] * ny[j]
        sim = np.where(n > 0, exact(x[i], y[j]) / np.where(n > 0, n, 1), 0.0)
        o = np.lexsort((at[j], -sim, i))
        first = o[np.append(True, i[o][1:] != i[o][:-1])]
        return pa.table({"case": c.column("case"), "pos": c.column("pos"), "best": pa.array(at[j[first]]), "sim": pa.array(sim[first])})

    def dealt(df, own, n, other, m):
        # new columns, as both sides may come from one frame
        return df.select(*[F.col(c).alias(c) for c in ("case", "pos", "vec")], F.pmod(F.xxhash64("pos"), F.lit(n).cast("long")).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    types, kinds = dict(claim.dtypes), dict(source.dtypes)
    keys = ["case", "down", "across"]
    found = dealt(claim, "down", down, "across", across).groupBy(*keys).cogroup(dealt(source, "across", across, "down", down).groupBy(*keys)).applyInArrow(best, f"case {types['case']}, pos {types['pos']}, best {kinds['pos']}, sim double")
    return found.groupBy("case", "pos").agg(F.max_by("best", F.struct("sim", -F.col("best"))).alias("best"), F.max("sim").alias("sim"))


def monotone_share(aligned: DataFrame) -> DataFrame:
    """(case, share): of neighbouring claim tokens, those whose best positions do not fall; 1 for a single token."""
    by = Window.partitionBy("case").orderBy("pos")
    steps = aligned.select("case", F.col("best"), F.lag("best").over(by).alias("before"))
    n = F.count("before")
    return steps.groupBy("case").agg(F.when(n > 0, F.count_if(F.col("best") >= F.col("before")) / n).otherwise(1.0).alias("share"))


def alignment_score(aligned: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(case, score, verdict): .40 mean + .20 least + .25 numeric match + .15 monotone share, and its thresholds. numbers: (case, n), the share of numbers that match; 1 where it is not given."""
    base = aligned.groupBy("case").agg(F.avg("sim").alias("mean"), F.min("sim").alias("least"), F.count_if(F.col("sim") < 0.4).alias("low"))
    x = base.join(monotone_share(aligned), "case")
    x = x.join(numbers, "case").withColumnRenamed("n", "numeric") if numbers is not None else x.withColumn("numeric", F.lit(1.0))
    x = x.withColumn("score", 0.40 * F.col("mean") + 0.20 * F.col("least") + 0.25 * F.col("numeric") + 0.15 * F.col("share"))
    verdict = F.when((F.col("score") >= 0.65) & (F.col("numeric") >= 0.5) & (F.col("low") == 0), "SUPPORT").when((F.col("score") < 0.45) | (F.col("numeric") < 0.3) | (F.col("low") >= 2), "CONTRADICT").otherwise("NEUTRAL")
    return x.select("case", "score", verdict.alias("verdict"))
