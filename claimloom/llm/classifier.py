"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k (operator 6)."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .keyed import pack, unpack

BUCKETS = 1 << 20
NGRAM = 2
SLICES = 64
#: At most so many labelled rows are used to fit, those of least hash; statistics of raw text cover every document.
MAX_LABELLED = 200_000
#: Smoothing of the target model, in occurrences at the raw model's rate. A bucket leaves the raw model only on evidence from labelled
#: documents: its likelihood ratio (nats, over that which chance gives the best of all buckets) and how many times as frequent it is
#: on one side. Else both models give it the same probability, as smoothing toward the raw model would with rare n-grams.
KAPPA = 1.0
LEAST_NATS = 3.0
LEAST_TIMES = 4.0
#: Evidence floors tried: LEAST_NATS over chance, then FLOOR_STEP times as much each time. Copies of one bad document lend evidence to its
#: harmless words; of the floors, labelled rows choose the one whose weights separate them best.
FLOORS = 16
FLOOR_STEP = 1.4
#: Losing a share of the good documents counts so many times keeping that share of the others.
COST = 5.0
#: Scale of log weights against the Gumbel noise; 1 draws by the importance weights themselves.
TEMPERATURE = 1.0
MARKS = bytes.maketrans(b".,;:?\"()", b" " * 8)


def tokens(text: str | None) -> list[bytes]:
    """Runs without white space, case kept; sentence marks other than ! are white space."""
    return text.encode("utf-8", "surrogatepass").translate(MARKS).split() if text else []


def buckets(text: str | None, size: int = BUCKETS, ngram: int = NGRAM):
    """The hash buckets of the whole text's token n-grams, case kept, and how often each occurs."""
    import numpy as np

    run = tokens(text)
    if not run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(crc32, run), np.uint64, len(run))
    shift = np.uint64(64 - size.bit_length() + 1)
    grams, run = [h * np.uint64(0x9E3779B97F4A7C15) >> shift], h
    for n in range(1, ngram):
        run = (run[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[n:]
        grams.append(run * np.uint64(0x9E3779B97F4A7C15) >> shift)
    at = np.sort(np.concatenate(grams).astype(np.int32))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.diff(np.append(first, len(at)))


def signature(text: str | None, words: int = 5) -> int:
    """The least hash of the text's word shingles: near copies mostly share it."""
    import numpy as np

    run = tokens(text)
    h = np.fromiter(map(crc32, run), np.uint64, len(run))
    run = h
    for n in range(1, min(words, len(h))):
        run = (run[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[n:]
    run = (run ^ run >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return int(run.min() >> np.uint64(1)) if len(run) else 0


def one_of_copies(labelled: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _side) of labelled rows, one for each group of (near) copies, so that a much copied text weighs no more than another."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_side"), pa.array([signature(t.as_py()) for t in b.column("_text")], pa.int64())], names=["_id", "_side", "sig"])

    kind = dict(labelled.dtypes)[key]
    signed = labelled.select(F.col(key).alias("_id"), "_side", F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, _side boolean, sig long")
    return signed.groupBy("sig").agg(F.min_by(F.struct("_id", "_side"), "_id").alias("one")).select("one._id", "one._side")


#: What is counted for each bucket: occurrences in all documents and in target ones; target and other labelled documents that have it.
RAW, TARGET, GOOD, BAD = range(4)


def _count(size: int, ngram: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((4, size), np.int64)
        docs = np.zeros(2, np.int64)  # target and other labelled documents
        seen = False
        for b in batches:
            for t, side in zip(b.column("t"), b.column("side").to_pylist(), strict=True):
                at, n = buckets(t.as_py(), size, ngram)
                seen = True
                total[RAW, at] += n
                if side is not None:
                    total[GOOD if side else BAD, at] += 1
                    docs[0 if side else 1] += 1
                    if side:
                        total[TARGET, at] += n
        if seen:
            step = size // SLICES
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(range(SLICES), pa.int32()),
                "counts": pa.array([pack(total[:, i * step : (i + 1) * step].ravel()) for i in range(SLICES)], pa.binary()),
                "docs": pa.array([docs.tolist() if i == 0 else [0, 0] for i in range(SLICES)], pa.list_(pa.int64())),
            })

    return run


def _add(size: int):
    def run(t):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size // SLICES * 4, np.int64)
        for c in t.column("counts"):
            total += unpack(c.as_py(), len(total), np.int64)
        docs = np.array(t.column("docs").to_pylist()).sum(axis=0)
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([pack(total)], pa.binary()), "docs": pa.array([docs.tolist()], pa.list_(pa.int64()))})

    return run


def fit(docs: DataFrame, side: Column, text: str = "text", size: int = BUCKETS, ngram: int = NGRAM):
    """For each hash bucket, log p_target - log p_raw of two multinomials over n-gram counts, and how many evidence floors it passes.

    side: true for target rows, false for other labelled rows, null for the rest. The raw model counts all documents, repeats
    included; the target model counts target rows, smoothed toward the raw one. Ratios of either sign count.
    """
    import numpy as np

    parts = docs.select(F.col(text).alias("t"), side.alias("side")).mapInArrow(_count(size, ngram), "slice int, counts binary, docs array<long>")
    rows = parts.groupBy("slice").applyInArrow(_add(size), "slice int, counts binary, docs array<long>").orderBy("slice").collect()  # SLICES rows
    if not rows:
        return np.zeros(size, np.float32), np.zeros(size, np.int8)
    n_good, n_bad = (max(1, x) for x in rows[0]["docs"])
    width = 4 * size // SLICES
    slices = lambda: (unpack(r["counts"], width, np.int64).reshape(4, -1) for r in rows)  # noqa: E731  # one at a time, twice
    sums = sum(c.sum(axis=1) for c in slices())
    floor = LEAST_NATS + np.log(max(2, sum(int(np.count_nonzero(c[GOOD] + c[BAD])) for c in slices())))
    q, rate = n_bad / (n_good + n_bad), sums[TARGET] / max(1, sums[RAW])
    weights, levels = [], []
    for c in slices():
        good, bad = c[GOOD].astype(float), c[BAD].astype(float)
        ratio = np.log((c[TARGET] + KAPPA) / (c[RAW] * rate + KAPPA))
        share = (bad + 1e-9) / (bad + good + 2e-9)
        evidence = bad * np.log(share / q) + good * np.log((1 - share) / (1 - q))
        lean = np.log((good + 0.5) / (n_good + 1)) - np.log((bad + 0.5) / (n_bad + 1))
        level = np.where(np.abs(lean) >= np.log(LEAST_TIMES), np.clip(np.floor(np.log(np.maximum(evidence, 1e-9) / floor) / np.log(FLOOR_STEP)) + 1, 0, FLOORS), 0)
        weights.append(np.where(level > 0, ratio, 0).astype(np.float32))
        levels.append(level.astype(np.int8))
    return np.concatenate(weights), np.concatenate(levels)


def score(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ngram: int = NGRAM) -> DataFrame:
    """keep and `scores`: the text's log importance weight, the sum of the log ratios of all its n-grams, for each evidence floor; 0 for no text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many numbers as buckets

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, level = shared.value
        for b in batches:
            s = []
            for t in b.column("_text"):
                at, n = buckets(t.as_py(), len(w), ngram)
                by = np.bincount(level[at], w[at] * n, minlength=FLOORS + 1)
                s.append(by[:0:-1].cumsum()[::-1])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s, pa.list_(pa.float64()))], names=[*keep, "scores"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "scores array<double>"]))


def gumbel_top_k(scored: DataFrame, k: int, key: Column, temperature: float = TEMPERATURE) -> DataFrame:
    """scored with `sampled`: true for the k rows of highest score / temperature plus Gumbel noise (a draw without replacement).

    The noise comes from a hash of key, so a row keeps it when computed again. The k-th value is found by counting rows in
    finer and finer bins, a few numbers a round, not by a sort into one task. Rows that tie with it to the last bit are all taken.
    """
    u = (F.pmod(F.xxhash64(key.cast("string"), F.lit("gumbel")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    noisy = cut(scored.withColumn("_noisy", F.col("score") / F.lit(temperature) - F.log(-F.log(u))))
    low, high, n = noisy.agg(F.min("_noisy"), F.max("_noisy"), F.count("*")).first()
    if not n or k >= n:
        return noisy.withColumn("sampled", F.lit(True)).drop("_noisy")
    if k <= 0:
        return noisy.withColumn("sampled", F.lit(False)).drop("_noisy")
    above = 0  # rows over the current range
    for _ in range(12):
        step = (high - low) / 1024
        if step <= 0 or low + step == low:
            break
        at = F.least(F.floor((F.col("_noisy") - F.lit(low)) / F.lit(step)), F.lit(1023))
        counts = dict(noisy.where(F.col("_noisy").between(low, high)).groupBy(at.alias("bin")).agg(F.struct(F.count("*"), F.min("_noisy"), F.max("_noisy"))).collect())
        for b in sorted(counts, reverse=True):
            c, low_b, high_b = counts[b]
            if above + c >= k:
                low, high = low_b, high_b
                break
            above += c
        if low == high or above + c == k:
            break
    return noisy.withColumn("sampled", F.col("_noisy") >= F.lit(low)).drop("_noisy")


def sides(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(_id, _side) of at most max_labelled labelled ids, those of least hash. Of repeated labels the worse counts; one column that says bad decides."""
    lab = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    side = F.when((F.col("q") <= 0) | (F.col("x") > 0), False).when((F.col("q") > 0) & (F.col("x") == 0), True)
    return lab.select(F.col("doc_id").alias("_id"), side.alias("_side")).where("_side is not null").orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs' rows as (key, text_id, score, kept): documents drawn by importance resampling to resemble the target, those labelled of quality and not toxic.

    score is the log importance weight. The sample's size k is the sum of all weights, each cut at 1: as many documents as the
    target distribution accounts for. k rows are drawn without replacement by Gumbel noise on the scores. Ids without a document
    and labels that say neither good nor bad are left out; without labels of both sides every document is kept. Documents without
    text have weight 1. Rows are judged one by one: repeated rows get equal results. text_id is xxhash64(text). Other columns are not read.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text_id"), F.col(text).alias("_text"))
    lab = cut(sides(labels, max_labelled))
    # both broadcasts have at most max_labelled rows
    lab = cut(one_of_copies(narrow.join(F.broadcast(lab), F.col("_key") == F.col("_id")), "_key", "_text"))
    sided = narrow.join(F.broadcast(lab), F.col("_key") == F.col("_id"), "left")
    scored = cut(score(sided, fit(sided, F.col("_side"), "_text"), "_text", ("_key", "_text_id", "_side")))
    floor = best_floor(scored.where("_side is not null"))
    scored = scored.select("_key", "_text_id", F.get("scores", F.lit(floor)).alias("score"))
    k = scored.agg(F.sum(F.least(F.lit(1.0), F.exp("score")))).first()[0] or 0
    drawn = gumbel_top_k(scored, round(k), F.concat_ws("/", F.col("_key").cast("string"), F.col("_text_id").cast("string")))
    return drawn.select(F.col("_key").alias(key), F.col("_text_id").alias("text_id"), "score", F.col("sampled").alias("kept"))


def best_floor(labelled: DataFrame) -> int:
    """The evidence floor at which labelled rows are separated best: least COST times the weight that good ones lose plus that which others keep. Without rows of both sides, the highest."""
    each = labelled.select("_side", F.posexplode("scores").alias("floor", "s"))
    kept = {(r[0], r[1]): r[2] for r in each.groupBy("floor", "_side").agg(F.avg(F.least(F.lit(1.0), F.exp("s")))).collect()}  # two numbers a floor
    cost = {f: COST * (1 - kept[f, True]) + kept[f, False] for f in range(FLOORS) if (f, True) in kept and (f, False) in kept}
    return min(cost, key=lambda f: (cost[f], f)) if cost else FLOORS - 1


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_id")


#: A learned model: tested on labelled rows that it was not fitted on.
QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
