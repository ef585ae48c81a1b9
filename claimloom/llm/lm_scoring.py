"""Language-model scoring by deleted interpolation (operator 5): bigrams, words and a uniform floor, mixed by context frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .keyed import bucket_bounds, buckets_of, key_bits, pack, pack_sorted, packed, settle, unpack, unpack_rows, unpack_sorted, volume
from .language_id import fold

#: One training text in HELD, by its hash, is the deleted part: its counts fit the mixture, the counts of the others are mixed.
HELD = 8
#: Contexts fall in classes by the bits of their count.
CLASSES = 40
ROUNDS = 100
#: Held-out estimates are counted in cells of 2**(1/GRID) each way, with each cell's own means.
GRID = 12
#: Pair keys have so many bits more than the text has bytes by logarithm: one pair in 2**SPARE shares another's count.
SPARE = 14
#: Strings hashed for a text's start and end; no word has white space.
START, END = b"\n<", b"\n>"


class Batch:
    """The distinct words and word pairs of a batch as sorted keys, and where each token's are."""

    def __init__(self, texts, bits: int):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if not len(texts):
            texts = pa.array([None], pa.binary())[:0]
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        raw = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)  # split by byte, whatever the bytes are
        lists = pc.ascii_split_whitespace(pc.ascii_lower(raw))
        flat = lists.flatten()
        some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(some, dtype=np.int64))
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        words = ends[bounds[1:]] - ends[bounds[:-1]]
        coded = flat.filter(pa.array(some)).dictionary_encode()
        kinds = coded.dictionary.cast(pa.binary()).to_pylist()
        v = len(kinds)
        self.sizes = words + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        last = self.starts + words
        token = np.full(int(self.sizes.sum()), v, np.int64)
        is_end = np.zeros(len(token), bool)
        is_end[last] = True
        token[~is_end] = coded.indices.to_numpy()
        before = np.append(v + 1, token[:-1])[: len(token)]
        before[self.starts] = v + 1
        h = np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in [*kinds, END, START]), np.uint64, v + 2)
        used = np.arange(v + 1) if len(token) else np.zeros(0, np.int64)
        order = used[np.argsort(h[used])]
        self.words = h[order]
        place = np.zeros(v + 2, np.int64)
        place[order] = np.arange(len(order))
        place[v + 1] = len(order)  # the start has no key: its count is that of texts
        self.word, self.before = place[token], place[before]
        mixed = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        pair = mixed[before] + h[token]
        pair = (pair ^ pair >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        pair = (pair ^ pair >> np.uint64(32)) >> np.uint64(64 - bits)
        order = np.argsort(pair)
        inorder = pair[order]
        new = np.append(True, inorder[1:] != inorder[:-1])[: len(order)]
        self.pairs = inorder[new]
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1


def _both(row, what: str, dtype):
    """A message's two lists: of words, of pairs."""
    return unpack(row[what + "w"], row["nw"], dtype), unpack(row[what + "p"], row["np"], dtype)


MESSAGE = "bucket int, batch long, lane int, nw long, np long, kw binary, kp binary, cw binary, cp binary"
ANSWER = "batch long, bucket int, nw long, np long, tw binary, tp binary, rw binary, rp binary, stats array<long>"
#: Lanes: texts outside training, training texts, and the deleted part of training.
OTHER, TAUGHT, DELETED = range(3)


def count_keys(batches: DataFrame, buckets: int, bits: int) -> DataFrame:
    """For each batch and bucket its keys' counts over all training text (t), and for deleted batches without the deleted part (r), in the batch's order.

    Rows of batch -1 hold, for each bucket, the number of training tokens, of distinct ones, and of tokens outside the deleted part.
    """

    def ask(parts):
        import numpy as np
        import pyarrow as pa

        for p in parts:
            for batch, lane, blob in zip(*(p.column(c).to_pylist() for c in ("batch", "lane", "rows")), strict=True):
                b = Batch(unpack_rows(blob).column("t"), bits)
                taught = lane != OTHER
                lists = []
                for keys, where, width in ((b.words, b.word, 64), (b.pairs, b.pair, bits)):
                    counts = np.bincount(where, minlength=len(keys)).astype(np.uint32) if taught else np.zeros(len(keys), np.uint32)
                    lists.append((keys, counts, bucket_bounds(keys, buckets, width)))
                (kw, cw, aw), (kp, cp, ap) = lists
                some = np.flatnonzero(np.diff(aw) + np.diff(ap)).tolist()
                w, q = [slice(aw[i], aw[i + 1]) for i in some], [slice(ap[i], ap[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([lane] * len(some), pa.int32()),
                        pa.array([x.stop - x.start for x in w], pa.int64()), pa.array([x.stop - x.start for x in q], pa.int64()),
                        pa.array([pack_sorted(kw[x]) for x in w], pa.binary()), pa.array([pack_sorted(kp[x]) for x in q], pa.binary()),
                        pa.array([pack(cw[x]) for x in w], pa.binary()), pa.array([pack(cp[x]) for x in q], pa.binary()),
                    ],
                    names=["bucket", "batch", "lane", "nw", "np", "kw", "kp", "cw", "cp"],
                )

    def add(t):
        import numpy as np
        import pyarrow as pa

        rows = t.to_pylist()
        lane = np.array([r["lane"] for r in rows])
        out = {"w": [], "p": []}
        stats = [0, 0, 0]
        for kind, size in (("w", "nw"), ("p", "np")):
            sizes = np.array([r[size] for r in rows], np.int64)
            keys = np.concatenate([unpack_sorted(r["k" + kind], r[size]) for r in rows])
            counts = np.concatenate([unpack(r["c" + kind], r[size], np.uint32) for r in rows]).astype(np.int64)
            order = np.argsort(keys)
            new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(order)]
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            n = int(new.sum())
            total = np.bincount(place, counts, n).astype(np.uint64)
            rest = total - np.bincount(place, counts * np.repeat(lane == DELETED, sizes), n).astype(np.uint64)
            if kind == "w":
                stats = [int(total.sum()), int(np.count_nonzero(total)), int(rest.sum())]
            ends = np.cumsum(sizes)
            for r, size_, end in zip(rows, sizes, ends, strict=True):
                mine = place[end - size_ : end]
                out[kind].append((pack(total[mine]), pack(rest[mine]) if r["lane"] == DELETED else b""))
        return pa.table({
            "batch": pa.array([*t.column("batch").to_pylist(), -1], pa.int64()), "bucket": pa.array([*t.column("bucket").to_pylist(), rows[0]["bucket"]], pa.int32()),
            "nw": pa.array([*t.column("nw").to_pylist(), 0], pa.int64()), "np": pa.array([*t.column("np").to_pylist(), 0], pa.int64()),
            "tw": pa.array([*(x[0] for x in out["w"]), b""], pa.binary()), "tp": pa.array([*(x[0] for x in out["p"]), b""], pa.binary()),
            "rw": pa.array([*(x[1] for x in out["w"]), b""], pa.binary()), "rp": pa.array([*(x[1] for x in out["p"]), b""], pa.binary()),
            "stats": pa.array([*[None] * len(rows), stats], pa.list_(pa.int64())),
        })

    return batches.select("batch", "lane", "rows").mapInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(add, ANSWER)


def _token_counts(b: Batch, answers, which: str, texts: int):
    """Counts of each token's context, pair and word; texts is the count of the start."""
    import numpy as np

    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    lists = [_both(r, which, np.uint64) for r in rows]
    w, p = (np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in lists)]).astype(np.float64) for i in range(2))
    if len(w) != len(b.words) or len(p) != len(b.pairs):
        raise RuntimeError(f"{len(b.words)} words and {len(b.pairs)} pairs were asked for, {len(w)} and {len(p)} answered")
    return np.append(w, texts)[b.before], p[b.pair], np.append(w, texts)[b.word]


def _class(count):
    import numpy as np

    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, CLASSES - 1), 0).astype(np.int64)


def cells_of(context, pair, word):
    """Held-out tokens in cells of like estimates: class of context, pair estimate, word count; their number and sums."""
    import numpy as np

    share = pair / np.maximum(context, 1)
    grid = lambda x: np.where(x > 0, np.round(GRID * np.log2(np.maximum(x, 1e-30))), -9999).astype(np.int64)
    key = (_class(context) << 40) + ((grid(share) + 10000) << 20) + grid(word) + 10000
    key, place = np.unique(key, return_inverse=True)
    n = np.bincount(place, minlength=len(key))
    return key, n.astype(np.int64), np.bincount(place, share, len(key)).astype(float), np.bincount(place, word, len(key)).astype(float)


def learn_mixture(key, n, p2, c1, tokens: float, distinct: float):
    """Per class the weights of pair, word and uniform estimates, by expectation-maximisation on held-out cells."""
    import numpy as np

    out = np.tile([0.0, 0.9, 0.1], (CLASSES, 1))
    for k in range(CLASSES):
        mine = np.asarray(key) >> 40 == k
        if not mine.any():
            if k:
                out[k] = out[k - 1]
            continue
        m = np.asarray(n, float)[mine]
        p = np.stack([np.asarray(p2)[mine] / m, np.asarray(c1)[mine] / m / max(tokens, 1), np.full(len(m), 1 / (distinct + 1))], axis=1)
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * m[:, None]).sum(axis=0) / m.sum()
        w = np.maximum(w, 1e-6)
        out[k] = w / w.sum()
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def deleted(text: Column, held: int = HELD) -> Column:
    """Whether a training text belongs to the deleted part: by its hash alone, so equal texts do so together."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(held)) == 0


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), **sizes) -> DataFrame:
    """One row per row of docs: key, keep, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities).

    learn marks the training rows (null: no). Words and word pairs of all training rows are counted. score mixes a pair's share of
    its context, the word's share of all tokens, and a uniform floor over the distinct words and one unknown, by weights for the
    class of the context's count (powers of two); the weights are learned by expectation-maximisation on a deleted eighth of
    the training texts with counts of the others. base_score has add-one word shares. Null and empty texts are an end token alone.
    Without training rows every token is unknown and score is 0. Repeated rows are counted and returned each; null keys pass through.
    Words are told apart by 64-bit hashes, pairs by hashes whose width follows the input (SPARE).

    Texts are packed once where they are read; each batch asks buckets for its distinct keys' counts, so what moves is lists of
    keys, and texts once more, compressed. sizes: batch_bytes, bucket_bytes.
    """
    kinds = dict(docs.dtypes)
    lane = F.when(~F.coalesce(learn, F.lit(False)), OTHER).when(deleted(F.col(text)), DELETED).otherwise(TAUGHT)
    rows = docs.select(F.col(key).alias("k"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), lane.alias("lane"), F.col(text).alias("t"))
    batches = packed(rows, "t", "lane", **{k: v for k, v in sizes.items() if k == "batch_bytes"})
    total = volume(batches)
    bits = key_bits(total, SPARE)
    counted = settle(lambda: count_keys(batches, buckets_of(total, **{k: v for k, v in sizes.items() if k == "bucket_bytes"}), bits))
    stats = counted.where("batch = -1").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(3)]).first()
    tokens, distinct, tokens_rest = stats
    by_lane = {r[0]: r[1] for r in batches.groupBy("lane").agg(F.sum("n")).collect()}
    n_taught, n_rest = by_lane.get(TAUGHT, 0) + by_lane.get(DELETED, 0), by_lane.get(TAUGHT, 0)
    answers = counted.where("batch >= 0").drop("stats")

    def held_cells(left, right):
        import pyarrow as pa

        if not left.num_rows:
            key, n, p2, c1 = [], [], [], []
        else:
            b = Batch(unpack_rows(left.column("rows")[0].as_py()).column("t"), bits)
            key, n, p2, c1 = cells_of(*_token_counts(b, right, "r", n_rest))
        return pa.table({"cell": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64()), "p2": pa.array(p2, pa.float64()), "c1": pa.array(c1, pa.float64())})

    held = batches.where(F.col("lane") == DELETED).select("batch", "rows")
    asked = answers.join(F.broadcast(held.select("batch")), "batch", "left_semi")  # a number a batch
    cells = held.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(held_cells, "cell long, n long, p2 double, c1 double")
    # as many cells as classes and steps of the two grids, however much text there is
    found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("c1").alias("c1")).orderBy("cell").toArrow()
    mix = learn_mixture(*(found.column(c).to_numpy() for c in ("cell", "n", "p2", "c1")), tokens_rest, distinct)

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        rows = unpack_rows(left.column("rows")[0].as_py())
        b = Batch(rows.column("t"), bits)
        context, pair, word = _token_counts(b, right, "t", n_taught)
        w = mix[_class(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (distinct + 1)
        if not tokens:
            p = np.ones(len(p))
        base = np.log10((word + 1) / (tokens + (distinct + 1)))
        add = lambda x: np.add.reduceat(x, b.starts) if len(x) else x
        kept = rows.column("kept")
        out = {key: rows.column("k"), **{k: kept.combine_chunks().field(i) for i, k in enumerate(keep)}}
        return pa.table({**out, "n_tokens": b.sizes, "n_known": add((word > 0).astype(np.int64)), "train_tokens": np.full(len(b.sizes), tokens, np.int64), "base_score": add(base), "score": add(np.log10(p))})

    schema = ", ".join([f"`{key}` {kinds[key]}", *(f"`{k}` {kinds[k]}" for k in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return batches.select("batch", "rows").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score_texts(docs, ~F.col("held_out"), keep=("held_out",))


#: A learned model over hashed counts: counts, base_score and score are tested by brute force.
QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLE: dict[str, str] = {}
