"""Media columns: chroma audio fingerprints and their alignment (operator 7)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

RATE = 5512
FRAME = 1024
HOP = 512
#: Pitches from MIDI 36 on count; a filter spans so many frames at most.
LOW, WIDE = 36, 8
#: The share of bits that may differ over the whole overlap of two recordings, and the integers that must overlap.
MAX_ERROR = 0.15
MIN_OVERLAP = 24
#: A search key: the signs (16 bits) of so many integers, WIDE places apart, so that no frame counts twice.
PARTS = 3
#: Keys equal but for one bit at most that must vote for an offset.
MIN_VOTES = 1
#: A key at more places than this is hot: its places are dealt to so many tasks that each has no more.
HOT_PLACES = 100_000
#: The query's recordings: notes taken over from the next row, and noise of so much of a tone's amplitude.
TAIL = 44
NOISE = 0.02


@lru_cache(maxsize=1)
def _pitch_classes():
    import numpy as np

    hz = np.fft.rfftfreq(FRAME, 1 / RATE)[1:]
    pitch = 69 + 12 * np.log2(hz / 440)
    out = np.zeros((len(hz) + 1, 12), np.float32)
    ok = pitch >= LOW
    out[1:][ok, np.round(pitch[ok]).astype(int) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """16 of (kind, first pitch class, pitch classes, frames). Kinds: whole, lower-upper, early-late, corners, middle."""
    return [(i % 5, (5 * i) % 9, 3 + i % 2, 4 + 4 * (i % 2)) for i in range(16)]


def chroma_fingerprint(pcm):
    """Packed 32-bit integers of a recording (samples at RATE), one for each frame that a filter can begin at.

    Frames of energy by pitch class are scaled to unit length; differences of areas, read from their integral image, are
    coded in two bits each (Gray code of a sign and a size).
    """
    import numpy as np

    pcm = np.asarray(pcm, np.float32)
    n = (len(pcm) - FRAME) // HOP + 1
    if n < WIDE:
        return np.zeros(0, np.uint32)
    at = np.arange(n)[:, None] * HOP + np.arange(FRAME)
    power = np.abs(np.fft.rfft(pcm[at] * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32) ** 2
    chroma = np.sqrt(power @ _pitch_classes())
    chroma /= np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-6)
    image = np.zeros((n + 1, 13), np.float64)
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n - WIDE + 1)
    area = lambda a, b, y, z: image[t + b, z] - image[t + a, z] - image[t + b, y] + image[t + a, y]
    out = np.zeros(len(t), np.uint32)
    for kind, y, h, w in filters():
        z, mid, half = y + h, y + h // 2, w // 2
        whole = area(0, w, y, z)
        if kind == 0:
            x = 2 * whole - area(0, w, 0, 12) * h / 6
        elif kind == 1:
            x = whole - 2 * area(0, w, y, mid)
        elif kind == 2:
            x = whole - 2 * area(0, half, y, z)
        elif kind == 3:
            x = whole - 2 * (area(0, half, y, mid) + area(half, w, mid, z))
        else:
            x = whole - 2 * area(w // 4, w - w // 4, y, z)
        edge = 0.12 * w
        code = (x > -edge).astype(np.uint32) + (x > 0) + (x > edge)
        out = out << np.uint32(2) | (code ^ code >> np.uint32(1))
    return out


def render(values, note: int = 512, noise: float = 0.0, seed: int = 0):
    """A recording of a vector: one note for each value, louder partials for larger ones, and white noise. Null values are silent."""
    import numpy as np

    v = np.array([0.0 if x is None else x for x in values], np.float32)
    v = np.nan_to_num(v, posinf=0, neginf=0)
    v = v / max(float(np.abs(v).max(initial=0)), 1e-9)
    hz = 440 * 2 ** ((57 + np.round(18 * v) - 69) / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(hz, note)) / RATE
    pcm = (np.sin(phase) + 0.3 * np.sin(2 * phase)).astype(np.float32)
    return pcm + np.random.default_rng(seed).normal(0, noise, len(pcm)).astype(np.float32) if noise else pcm


def search_keys(prints, parts: int = PARTS):
    """For each place the signs of the integers there, WIDE places on, and so forth, packed; a sign is the higher bit of a filter's two."""
    import numpy as np

    p = np.asarray(prints, np.uint32).astype(np.uint64)
    n = len(p) - WIDE * (parts - 1)
    if n < 1:
        return np.zeros(0, np.int64)
    signs = np.zeros(len(p), np.uint64)
    for i in range(16):
        signs |= (p >> np.uint64(2 * i + 1) & np.uint64(1)) << np.uint64(i)
    out = np.zeros(n, np.uint64)
    for j in range(parts):
        out |= signs[j * WIDE : j * WIDE + n] << np.uint64(16 * j)
    return out.view(np.int64)


def fingerprints(media: DataFrame, decode, key: str, column: str) -> DataFrame:
    """(k, prints, keys): decode turns (key, the column's value) into samples; null and short recordings have no prints."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            prints = [chroma_fingerprint(decode(k, x)) if x is not None else [] for k, x in zip(b.column("k").to_pylist(), b.column("x").to_pylist(), strict=True)]
            keys = [search_keys(p).tolist() for p in prints]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([list(map(int, p)) for p in prints], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["k", "prints", "keys"])

    src = media.select(F.col(key).alias("k"), F.col(column).alias("x"))
    return src.mapInArrow(run, f"k {dict(src.dtypes)['k']}, prints array<long>, keys array<long>")


def error_at(a, b, offset: int, min_overlap: int):
    """The share of bits that differ where b, moved by offset, overlaps a; none for too short an overlap."""
    import numpy as np

    x, y = a[max(offset, 0) :], b[max(-offset, 0) :]
    m = min(len(x), len(y))
    return None if m < max(min_overlap, 1) else float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m)


def votes(queries: DataFrame, classes: DataFrame, bits: int = 16 * PARTS, hot: int = HOT_PLACES) -> DataFrame:
    """(q, c, offset, votes): query and class of recordings have so many keys, equal but for one bit at most, at places that far apart.

    An inverted index by key: queries ask with each of their keys and its neighbours of one bit. A hot key's places are dealt to
    several tasks, and are asked in each.
    """
    places = classes.select("c", F.posexplode("keys").alias("at", "v"))
    many = places.groupBy("v").count().where(F.col("count") > hot).select("v", F.ceil(F.col("count") / hot).cast("int").alias("deals"))
    many = F.broadcast(cut(many))  # at most one row for each `hot` places
    near = F.concat(F.array("v"), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    asks = queries.select("q", F.posexplode("keys").alias("qat", "v")).select("q", "qat", F.explode(near).alias("v"))
    deals = F.coalesce("deals", F.lit(1)).cast("long")
    places = places.join(many, "v", "left").select("v", "c", "at", F.pmod(F.xxhash64("c"), deals).alias("deal"))
    asks = asks.join(many, "v", "left").select("v", "q", "qat", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("deal"))
    return asks.join(places, ["v", "deal"]).groupBy("q", "c", (F.col("at") - F.col("qat")).alias("offset")).agg(F.count("*").alias("votes"))


def search(media: DataFrame, decode, is_query, key: str, column: str, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(query, match, members, offset, votes, bit_error): for each query row, each class of recordings that aligns with it, at its best offset.

    Recordings of equal fingerprints are one class, named by its least key; members counts its rows (the query itself
    included), so a recording that a third of the rows share is compared once. Keys that are equal but for a bit vote for an
    offset; every offset with the votes is judged by the bits of all overlapping integers, and the best one stays (least error,
    most votes, least offset). Recordings of fewer than min_overlap integers match nothing; null keys are no queries and name
    no class. offset is the match's place less the query's, in frames. Keys may be of any type.
    """
    import numpy as np

    prints = cut(fingerprints(media, decode, key, column).where(F.size("prints") >= min_overlap).where("k is not null").withColumn("c", F.xxhash64("prints")))
    classes = cut(prints.groupBy("c").agg(F.min("k").alias("match"), F.count("*").alias("members"), F.first("prints").alias("prints"), F.first("keys").alias("keys"), F.max(is_query(F.col("k"))).alias("asks")))
    asking = classes.where("asks").select(F.col("c").alias("q"), "prints", "keys")
    found = votes(asking, classes).where(F.col("votes") >= min_votes)
    both = found.join(asking.select("q", F.col("prints").alias("x")), "q").join(classes.select("c", F.col("prints").alias("y")), "c")

    def check(batches):
        import pyarrow as pa

        for b in batches:
            errors = [error_at(np.array(y, np.uint32), np.array(x, np.uint32), o, min_overlap) for x, y, o in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            keep = pa.array([e is not None and e <= max_error for e in errors], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("c"), b.column("offset"), b.column("votes"), pa.array([e if e is not None else 9.0 for e in errors], pa.float64())], names=["q", "c", "offset", "votes", "bit_error"]).filter(keep)

    good = both.select("q", "c", "offset", "votes", "x", "y").mapInArrow(check, "q long, c long, offset int, votes long, bit_error double")
    best = good.groupBy("q", "c").agg(F.min(F.struct("bit_error", (-F.col("votes")).alias("less"), "offset")).alias("best"))
    named = best.join(classes.select("c", "match", "members"), "c").select(F.col("q").alias("c"), "match", "members", F.col("best.offset").cast("long").alias("offset"), (-F.col("best.less")).alias("votes"), F.col("best.bit_error").alias("bit_error"))
    queries = prints.where(is_query(F.col("k"))).select(F.col("k").alias("query"), "c")
    return queries.join(named, "c").drop("c")


def recordings(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", tail: int = TAIL) -> DataFrame:
    """(key, column): each vector, scaled to a largest value of 1, followed by the first values of the row of the next key, so that recordings overlap in time."""
    size = F.array_max(F.transform(column, lambda x: F.abs(x)))
    vectors = vectors.where(F.col(column).isNotNull()).select(key, F.transform(column, lambda x: x / F.greatest(size, F.lit(1e-9))).alias(column))
    after = vectors.groupBy((F.col(key) - 1).alias("_of")).agg(F.min(F.slice(column, 1, tail)).alias("_tail"))
    both = vectors.join(after, F.col(key) == F.col("_of"), "left")
    return both.select(key, F.concat(F.col(column), F.coalesce("_tail", F.slice(column, 1, 0))).alias(column))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = recordings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(media, lambda k, x: render(x, noise=NOISE, seed=abs(k or 0)), lambda k: k % 20 == 0, "vec_id", "embedding")


#: Signal processing is beyond SQL: matches and recall are tested against alignment by brute force at every offset.
QUERIES = {"op7_media_columns": op7_media_columns}
ORACLE: dict[str, str] = {}
