"""BPE encoding and decoding through a table of distinct words (operator 3)."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BATCH_BYTES = 8 << 20
#: Distinct words of so much text are encoded in one bucket.
BUCKET_BYTES = 64 << 20


def check_spec(spec: str) -> None:
    """Refuses a tokenizer whose ids or decoded text do not follow from the words between ASCII white space alone."""
    x = json.loads(spec)
    steps = x["normalizer"]["normalizers"] if (x.get("normalizer") or {}).get("type") == "Sequence" else [x["normalizer"]] if x.get("normalizer") else []
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps)
    pre = x.get("pre_tokenizer") or {}
    first = pre["pretokenizers"][0] if pre.get("type") == "Sequence" and pre["pretokenizers"] else pre
    pattern = (first.get("pattern") or {}).get("Regex", "")
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    whole = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not set(a["content"]) & set(" \t\n\r\v\f") for a in x.get("added_tokens", []))
    if not (plain and apart and whole and x.get("decoder") is None and x["model"]["type"] == "BPE" and not x["model"].get("dropout")):
        raise ValueError("this tokenizer is not word-wise BPE without a decoder")


class Codec:
    """A tokenizer file read once, and its table of pieces by id."""

    def __init__(self, spec: str):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.pieces = pa.array([self.tokenizer.id_to_token(i) for i in range(size)], pa.string())

    def encode(self, words: list[str]):
        """Ids of all words, and how many each has."""
        import numpy as np

        got = [e.ids for at in range(0, len(words), 10_000) for e in self.tokenizer.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.uint32)


@lru_cache(maxsize=1)
def codec(spec: str) -> Codec:
    """spec's codec. Each task brings its own copy of spec, which the cache compares in full: ask once a batch, not once a word."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Codec(spec)


def split(texts: list[bytes]):
    """The distinct words of texts, sorted; the word of each place; and where each text's places begin, and the end.

    Words are what stands between ASCII white space. No step of the tokenizer looks across it, so a text's ids are its words' ids
    in turn. Plain ASCII words are lower-cased (the tokenizer does so too), but for those that may hold a special token.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = pa.array(texts, pa.binary())
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(raw), raw.buffers()))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.append(0, np.cumsum(some, dtype=np.int64))[bounds]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    words = [w.decode("utf-8", "replace") for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    words = [w.lower() if w.isascii() and "<|" not in w else w for w in words]
    kinds = sorted(set(words))
    place = dict(zip(kinds, range(len(kinds)), strict=True))
    to = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    return kinds, to[coded.indices.to_numpy()], bounds


def encode_decode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, ids, decoded) per row: the whole text's token ids as little-endian unsigned 32-bit numbers, and what they decode to.

    spec is the tokenizer's JSON (word-wise BPE; others are refused). Batches of documents name their distinct words; each distinct
    word of the corpus goes to one bucket and is encoded once there by the tokenizer itself; ids come back in the order asked and
    are joined to word positions, then to pieces by id. A very frequent word is asked for once a batch. Null and empty texts give
    no ids and an empty string; bytes that are no UTF-8 count as U+FFFD. Repeated rows stay; null keys pass through; other columns are not read.
    """
    check_spec(spec)
    kind = dict(docs.dtypes)[key]
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16)).first()[0] or 0
    n, buckets = max(1, -(-total // batch_bytes)), max(1, -(-total // bucket_bytes))
    dealt = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("k", "t"), F.lit(n)))  # by the row alone: a lost batch is dealt again as it was
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one file

    def shrink(batches):
        import pyarrow as pa

        zstd = pa.Codec("zstd")
        for b in batches:
            raw = b.column("t").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([len(t) for t in raw], pa.int64()), pa.array([zstd.compress(t, asbytes=True) for t in raw], pa.binary()), b.column("batch")], names=["k", "size", "z", "batch"])

    def whole(t) -> list[bytes]:
        """A batch's texts."""
        import pyarrow as pa

        zstd = pa.Codec("zstd")
        return [zstd.decompress(z, size, asbytes=True) if size else b"" for z, size in zip(t.column("z").to_pylist(), t.column("size").to_pylist(), strict=True)]

    dealt = dealt.mapInArrow(shrink, f"k {kind}, size long, z binary, batch long")  # texts move compressed one by one

    def in_buckets(kinds: list[str]):
        """Places of the words that go to each bucket."""
        import numpy as np
        from zlib import crc32

        of = np.fromiter((crc32(w.encode("utf-8")) for w in kinds), np.int64, len(kinds)) % buckets
        order = np.argsort(of, kind="stable")
        return np.split(order, np.searchsorted(of[order], np.arange(1, buckets)))

    def ask(t):
        import pyarrow as pa

        kinds, _, _ = split(whole(t))
        rows = [(i, "\n".join([kinds[j] for j in at.tolist()]).encode(), len(at)) for i, at in enumerate(in_buckets(kinds)) if len(at)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([t.column("batch")[0].as_py()] * len(rows), pa.int64()), "size": pa.array([len(r[1]) for r in rows], pa.int64()), "words": pa.array([pa.compress(r[1], codec="zstd", asbytes=True) for r in rows], pa.binary())})

    def encode(t):
        import numpy as np
        import pyarrow as pa
        from .keyed import pack

        asked = [pa.decompress(w, decompressed_size=s, codec="zstd", asbytes=True).decode().split("\n") for w, s in zip(t.column("words").to_pylist(), t.column("size").to_pylist(), strict=True)]
        place: dict[str, int] = {}
        at = [np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int64, len(ws)) for ws in asked]
        ids, sizes = codec(shared.value).encode(list(place))
        ends = np.cumsum(sizes, dtype=np.int64)
        out = []
        for mine in at:
            n_ids = sizes[mine].astype(np.int64)
            first = np.repeat((ends - sizes)[mine] - (np.cumsum(n_ids) - n_ids), n_ids)
            out.append((len(mine), pack(sizes[mine]), int(n_ids.sum()), pack(ids[first + np.arange(len(first))])))
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "n_words": pa.array([o[0] for o in out], pa.int64()), "sizes": pa.array([o[1] for o in out], pa.binary()), "n_ids": pa.array([o[2] for o in out], pa.int64()), "ids": pa.array([o[3] for o in out], pa.binary())})

    def join(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from .keyed import unpack

        kinds, word, bounds = split(whole(left))
        back = {r["bucket"]: r for r in right.to_pylist()}
        order = [(at, back[i]) for i, at in enumerate(in_buckets(kinds)) if len(at)]
        none = np.zeros(0, np.int64)
        of = np.concatenate([none, *(at for at, _ in order)])
        sizes_in = np.concatenate([none, *(unpack(r["sizes"], r["n_words"], np.uint32).astype(np.int64) for _, r in order)])
        ids_in = np.concatenate([none.astype(np.uint32), *(unpack(r["ids"], r["n_ids"], np.uint32) for _, r in order)])
        sizes, begin = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        sizes[of], begin[of] = sizes_in, np.cumsum(sizes_in) - sizes_in
        n_ids = sizes[word]
        ends = np.append(0, np.cumsum(n_ids))
        ids = ids_in[np.repeat(begin[word] - ends[:-1], n_ids) + np.arange(ends[-1])].astype("<u4")
        bounds = ends[bounds]
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), codec(shared.value).pieces.take(pa.array(ids)))
        raw = pa.Array.from_buffers(pa.large_binary(), left.num_rows, [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids.tobytes())])
        return pa.table({key: left.column("k"), "ids": raw.cast(pa.binary()), "decoded": pc.binary_join(lists.cast(pa.list_(pa.string())), " ")})

    asked = dealt.groupBy("batch").applyInArrow(ask, "bucket int, batch long, size long, words binary")
    coded = asked.groupBy("bucket").applyInArrow(encode, "batch long, bucket int, n_words long, sizes binary, n_ids long, ids binary")
    return dealt.groupBy("batch").cogroup(coded.groupBy("batch")).applyInArrow(join, f"`{key}` {kind}, ids binary, decoded string")


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public word-wise BPE of 49,408 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    return coded.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer_spec()))


#: Merges are beyond SQL: tested against the tokenizers library.
QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
