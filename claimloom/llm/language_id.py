"""Language identification by hyperdimensional letter-trigram profiles (operator 8)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Components of a vector; texts multiplied together; n-gram vectors that a worker keeps.
DIM = 512
TEXTS = 64
KEPT = 20_000
SPACE = 32


@lru_cache(maxsize=4096)
def letter_vector(letter: int, dim: int = DIM):
    """The letter's own random vector of -1 and 1; the space between words has one too."""
    import numpy as np

    return np.where(np.random.Generator(np.random.PCG64(letter)).random(dim) < 0.5, -1, 1).astype(np.int8)


def ngram_vector(code: int, dim: int = DIM):
    """Three letters bound by product, each permuted (rotated) once more than the next."""
    import numpy as np

    a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(letter_vector(a, dim), 2) * np.roll(letter_vector(b, dim), 1) * letter_vector(c, dim)


@lru_cache(maxsize=1)
def _letters():
    import numpy as np

    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


_vectors: dict = {}


def ngram_matrix(codes, dim: int):
    """Rows of n-gram vectors; a worker keeps the first KEPT it made."""
    import numpy as np

    if dim not in _vectors:
        _vectors[dim] = ({}, np.zeros((KEPT, dim), np.float32))
    place, kept = _vectors[dim]
    codes = codes.tolist()
    for c in codes:
        if c not in place and len(place) < KEPT:
            kept[len(place)] = ngram_vector(c, dim)
            place[c] = len(place)
    rows = np.array([place.get(c, -1) for c in codes], np.int64)
    out = kept[rows]
    for i in np.flatnonzero(rows < 0):
        out[i] = ngram_vector(codes[i], dim)
    return out


def grams(texts):
    """(text number, trigram code) of every letter trigram of whole texts in lower case; words are apart by one space.

    A text without a letter has none.
    """
    import numpy as np

    who, code = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c = np.where(_letters()[c], c, SPACE)
        c = c[np.append(True, (c[1:] != SPACE) | (c[:-1] != SPACE))]
        if len(c) > 2:
            g = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
            code.append(g)
            who.append(np.full(len(g), i))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *who]), np.concatenate([none, *code])


def bundles(texts, dim: int = DIM):
    """One bundled vector per text (rows), and which texts have a letter."""
    import numpy as np

    out, some = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), bool)
    for at in range(0, len(texts), TEXTS):
        n = len(texts[at : at + TEXTS])
        who, code = grams(texts[at : at + TEXTS])
        some[at + np.unique(who)] = True
        kinds, place = np.unique(code, return_inverse=True)
        for first in range(0, len(kinds), 8192):  # texts of very many different letters are added up in parts
            part = (place >= first) & (place < first + 8192)
            width = min(8192, len(kinds) - first)
            counts = np.bincount(who[part] * width + place[part] - first, minlength=n * width).reshape(n, width)
            out[at : at + n] += counts.astype(np.float32) @ ngram_matrix(kinds[first : first + width], dim)
    return out, some


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, list[float]]:
    """Language to prototype: all its documents' n-grams bundled, each document with weight 1. A task sends one vector per language it met."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for name in dict.fromkeys(langs):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == name]
                for at in range(0, len(mine), 256):
                    who, code = grams(mine[at : at + 256])
                    kinds, place = np.unique(code, return_inverse=True)
                    share = np.bincount(place, 1 / np.maximum(np.bincount(who), 1)[who], minlength=len(kinds))
                    for first in range(0, len(kinds), 8192):
                        sums[name] = sums.get(name, 0) + share[first : first + 8192] @ ngram_matrix(kinds[first : first + 8192], dim)
        for name, s in sums.items():
            if np.ndim(s):
                yield pa.RecordBatch.from_pydict({"lang": [name] * dim, "i": pa.array(range(dim), pa.int32()), "x": s})

    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    total = known.mapInArrow(add, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, list[float]] = {}
    for r in total.orderBy("lang", "i").toLocalIterator():  # languages times dim numbers
        out.setdefault(r[0], []).append(r[2])
    return out


def predict(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text", dim: int = DIM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score: the prototype of highest cosine (ties: first name), and that cosine cut to 0..1.

    A null, empty or letterless text, or no prototypes, gives `und` and 0.
    """
    names = sorted(prototypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dim)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                v, some = bundles(b.column("_text").to_pylist(), dim)
                cos = v @ p.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                if not names:
                    cos, some = np.zeros((len(v), 1)), np.zeros(len(v), bool)
                best = cos.argmax(axis=1)
                score = np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).astype(np.float64)
                labels = [names[i] if s else "und" for i, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(labels, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double"]))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    out = predict(docs, train(docs.where("not held_out")), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


#: A learned model: tested by held-out accuracy.
QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
