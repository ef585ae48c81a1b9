"""Removal of repeated byte strings by suffix arrays over shards (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .keyed import buckets_of, key_bits, pack, pack_sorted, packed, raw_texts, settle, unpack, unpack_rows, unpack_sorted, volume

LENGTH = 50
#: Bytes of a string by whose hash strings are dealt out: the least hash among a string's parts is its anchor.
PART = 20
#: Text in a batch and in a bucket: a worker holds a few dozen bytes for each of a batch's, and a bucket's pieces.
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: A task sorts so many shards, one by one.
SHARDS = 4
#: An anchor whose strings take more bytes than this in the corpus is hot: they are dealt out one by one, by their own hash.
HOT_BYTES = 1 << 20
#: Anchor keys have so many bits more than the text has bytes by logarithm; a shared key only costs a comparison.
SPARE = 8


def anchors(b: bytes, length: int = LENGTH, part: int = PART):
    """For each string of `length` bytes that starts in b: the least hash of its parts."""
    import numpy as np

    n = len(b)
    if n < length:
        return np.zeros(0, np.uint64)
    base, most = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h, size, power = np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1), 1, base
    one = h
    for bit in bin(part)[3:]:  # polynomial hashes of doubled lengths
        h = h[: len(h) - size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power & most
        if bit == "1":
            h = h[:-1] * np.uint64(base) + one[size : size + len(h) - 1]
            size, power = size + 1, power * base & most
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, span = length - part + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if width > span:
        h = np.minimum(h[: span - width], h[width - span :])
    return h


def runs(b: bytes, length: int, part: int):
    """Consecutive starts with one anchor, at most 32 in a run: anchors, first starts, numbers of starts."""
    import numpy as np

    m = anchors(b, length, part)
    if not len(m):
        return m, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    count = np.diff(np.append(first, len(m)))
    if count.max() > 32:
        pieces = -(-count // 32)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, whole = np.repeat(first, pieces) + 32 * nth, np.repeat(count, pieces)
        first, count = at, np.minimum(32, whole - 32 * nth)
    return m[first], first, count


def bucket_starts(buckets: int, bits: int, width: int):
    """The least anchor key of each bucket, so that buckets get as many distinct anchors each.

    A hash is an anchor where it is the least of `width` in turn, so low keys are met far more often: one of x (0..1) is an anchor
    with a chance in proportion to (1 - x)**(width - 1) * (1 + (width - 1) * x). Made once, so that all tasks cut alike.
    """
    import numpy as np

    want = np.arange(buckets) / buckets
    low, high = np.zeros(buckets), np.ones(buckets)
    for _ in range(64):
        x = (low + high) / 2
        below = ((width + 1) * (1 - (1 - x) ** width) - (width - 1) * (1 - (1 - x) ** (width + 1))) / 2
        low, high = np.where(below < want, x, low), np.where(below < want, high, x)
    return (low * 2.0**bits).astype(np.uint64)


def _ids(column):
    """Document ids; null stands after all."""
    import numpy as np

    return np.array([np.iinfo(np.int64).max if x is None else x for x in column.to_pylist()], np.int64)


class Batch:
    """A batch's texts, the runs of their anchors, and the distinct anchor keys with what buckets need to know of them."""

    def __init__(self, blob: bytes, length: int, part: int, bits: int):
        import numpy as np

        self.rows, self.length = unpack_rows(blob), length
        self.texts, self.ids = raw_texts(self.rows.column("t")), _ids(self.rows.column("k"))
        found = [runs(b, length, part) for b in self.texts]
        self.key, self.first, self.count = (np.concatenate([np.zeros(0, t), *(r[i] for r in found)]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        self.key = self.key >> np.uint64(64 - bits)
        self.row = np.repeat(np.arange(len(found)), [len(r[0]) for r in found])
        self.keys, self.place = np.unique(self.key, return_inverse=True)

    def shared_inside(self):
        """Whether two rows of the batch have the anchor."""
        import numpy as np

        low, high = np.full(len(self.keys), len(self.texts)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.place, self.row)
        np.maximum.at(high, self.place, self.row)
        return low < high

    def bytes_of(self):
        """Bytes of each anchor's strings in the batch."""
        import numpy as np

        return np.bincount(self.place, self.count + self.length - 1, len(self.keys)).astype(np.uint32)

    def segments(self, flags, shards: int, buckets: int):
        """What the batch sends: for each bucket its sorted distinct byte strings, their shards and least rows' ids; and the occurrences.

        An occurrence is (row, first start, number of starts, bucket, place in the bucket's list).
        """
        import numpy as np
        import xxhash

        seen: list[dict[bytes, tuple]] = [{} for _ in range(buckets)]
        where = []
        f = flags[self.place]
        some = np.flatnonzero(f)
        of = ((self.key[some] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).tolist()
        ids = self.ids.tolist()
        for row, hot, at, c, shard in zip(self.row[some].tolist(), (f[some] > 1).tolist(), self.first[some].tolist(), self.count[some].tolist(), of, strict=True):
            b = self.texts[row]
            todo = [(x, 1, xxhash.xxh64_intdigest(b[x : x + self.length]) * shards >> 64) for x in range(at, at + c)] if hot else ((at, c, shard),)
            for x, n, sh in todo:
                piece, own = b[x : x + n + self.length - 1], (ids[row], sh)
                mine = seen[sh % buckets]
                if mine.setdefault(piece, own) > own:
                    mine[piece] = own
                where.append((row, x, n, sh % buckets, piece))
        lists = [sorted(d) for d in seen]
        places = [{p: i for i, p in enumerate(x)} for x in lists]
        return [(x, [d[p][0] for p in x], [d[p][1] // buckets for p in x]) for d, x in zip(seen, lists, strict=True)], [(row, x, n, i, places[i][p]) for row, x, n, i, p in where]


def met(pieces: list[bytes], length: int, part: int):
    """Whether another piece has the same anchor: one that is alone with its anchor has no string in common with any other."""
    import numpy as np

    sizes = np.array([len(p) for p in pieces], np.int64)
    key = anchors(b"".join(pieces), length, part)[np.cumsum(sizes) - sizes]  # a piece's strings have one anchor
    _, which, many = np.unique(key, return_inverse=True, return_counts=True)
    return many[which] > 1


def shard_repeats(pieces: list[bytes], least, length: int = LENGTH):
    """For each distinct piece a bit for each start: set if the string there also starts in a piece of a lesser document.

    The pieces' suffix array is made by induced sorting; strings of `length` bytes that are equal stand side by side in it, told
    by the permuted common prefixes.
    """
    import numpy as np
    from .suffix_array import permuted_prefixes, suffix_array

    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    raw = np.frombuffer(b"\0".join(pieces) + b"\0" + bytes(length + 16), np.uint8)
    s = np.zeros(ends[-1] + 1, np.int64)
    s[: ends[-1]] = raw[: ends[-1]].astype(np.int64) + 2
    s[ends - 1] = 1
    order = suffix_array(s, 258, length)
    starts = sizes - length + 1
    valid = np.zeros(len(s), bool)
    piece = np.repeat(np.arange(len(pieces)), starts)
    places = np.repeat(begin, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    valid[places] = True
    owner = np.zeros(len(s), np.int64)
    owner[places] = piece
    order = order[valid[order]]
    plcp = permuted_prefixes(raw, order, length)
    first = np.flatnonzero(plcp[order] < length)
    lowest = np.minimum.reduceat(least[owner[order]], first)
    lowest = np.repeat(lowest, np.diff(np.append(first, len(order))))
    hit = order[lowest < least[owner[order]]]
    bits = np.zeros(len(pieces), np.uint32)
    np.bitwise_or.at(bits, owner[hit], np.uint32(1) << (hit - begin[owner[hit]]).astype(np.uint32))
    return bits


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, part: int = PART, keep: tuple[str, ...] = (), characters: bool = False, **sizes) -> DataFrame:
    """(key, keep, n_bytes, n_removed, n_spans, kept binary) per row: each byte inside a string of `length` bytes that also starts in
    a document of lesser key is removed.

    1. Batches of documents list the anchors of their strings; buckets tell which anchors two documents have, so that only
    strings that may repeat go on. 2. These go to shards by anchor, each distinct piece of bytes once a batch; anchors with very
    many bytes are split up by string. A shard sorts its pieces' suffixes by induction and reads repeats and the least document
    of each off the common prefixes. 3. Batches cut the bytes out. Nothing is capped: a text is treated whole, however long.

    Null and short texts stay as they are (null: no bytes). Rows with one key do not remove each other's bytes; a null key is
    greater than all others. Keys are integers. Repeated rows stay; keep's columns pass through, others are not read.
    characters: a character of which a byte is removed goes whole, so that what is left of valid UTF-8 is valid.
    sizes: batch_bytes, bucket_bytes.
    """
    if not part < length <= part + 31:
        raise ValueError("a string needs to have between 1 and 31 bytes more than a part")
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(key).alias("k"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), F.col(text).alias("t"))
    sizes = {"batch_bytes": BATCH_BYTES, "bucket_bytes": BUCKET_BYTES} | sizes
    batches = packed(rows, "t", None, sizes["batch_bytes"])
    total = volume(batches)
    bits = key_bits(total, SPARE)
    buckets = buckets_of(total, sizes["bucket_bytes"])
    shards = buckets * SHARDS
    begins = bucket_starts(buckets, bits, length - part + 1)

    def ask(parts):
        import numpy as np
        import pyarrow as pa

        for p in parts:
            for batch, blob in zip(p.column("batch").to_pylist(), p.column("rows").to_pylist(), strict=True):
                b = Batch(blob, length, part, bits)
                more, size, at = b.shared_inside(), b.bytes_of(), np.append(np.searchsorted(b.keys, begins), len(b.keys))
                some = np.flatnonzero(np.diff(at))
                cuts = [slice(at[i], at[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([c.stop - c.start for c in cuts], pa.int64()), pa.array([pack_sorted(b.keys[c]) for c in cuts], pa.binary()), pa.array([pack(more[c].view(np.uint8)) for c in cuts], pa.binary()), pa.array([pack(size[c]) for c in cuts], pa.binary())],
                    names=["bucket", "batch", "n", "keys", "more", "size"],
                )

    def meet(t):
        import numpy as np
        import pyarrow as pa

        rows = t.to_pylist()
        keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(np.append(False, keys[order][1:] != keys[order][:-1])[: len(order)])
        del keys, order
        count = np.bincount(place)
        shared = count > 1
        shared[place[np.concatenate([unpack(r["more"], r["n"], np.uint8) for r in rows]) > 0]] = True
        hot = np.bincount(place, np.concatenate([unpack(r["size"], r["n"], np.uint32) for r in rows])) > HOT_BYTES
        flag = (shared.astype(np.uint8) + (shared & hot))[place]
        ends = np.cumsum([r["n"] for r in rows])
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "n": t.column("n"), "flags": pa.array([pack(flag[e - r["n"] : e]) for r, e in zip(rows, ends, strict=True)], pa.binary())})

    def send(left, right):
        import numpy as np
        import pyarrow as pa

        b = Batch(left.column("rows")[0].as_py(), length, part, bits)
        flags = np.concatenate([np.zeros(0, np.uint8), *(unpack(r["flags"], r["n"], np.uint8) for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]))])
        if len(flags) != len(b.keys):
            raise RuntimeError(f"{len(b.keys)} anchors were sent, {len(flags)} came back")
        lists, where = b.segments(flags, shards, buckets)
        some = [i for i, x in enumerate(lists) if x[0]]
        batch = left.column("batch")[0].as_py()
        out = {
            "bucket": some, "n": [len(lists[i][0]) for i in some], "sizes": [pack(np.array([len(p) for p in lists[i][0]], np.uint8)) for i in some],
            "pieces": [pa.compress(b"".join(lists[i][0]), codec="zstd", asbytes=True) for i in some], "least": [pack(np.array(lists[i][1], np.int64)) for i in some],
            "shards": [pack(np.array(lists[i][2], np.uint8)) for i in some], "where": [None] * len(some),
        }
        # where the pieces stand, for the batch itself: it passes the shards by, in a group of its own
        for name, value in (("bucket", -1 - batch), ("n", len(where)), ("sizes", None), ("pieces", None), ("least", None), ("shards", None), ("where", pack(np.array(where, np.int64).reshape(-1, 5).T.ravel()))):
            out[name].append(value)
        types = {"bucket": pa.int64(), "n": pa.int64()}
        return pa.table({"batch": pa.array([batch] * len(out["n"]), pa.int64()), **{k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()}})

    def sort(t):
        import numpy as np
        import pyarrow as pa

        if t.column("bucket")[0].as_py() < 0:
            none = pa.array([None], pa.binary())
            return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "n": t.column("n"), "bits": none, "low": none, "where": t.column("where")})
        known: dict[bytes, int] = {}
        places, lows, shard_of = [], [], []
        for r in t.to_pylist():
            sizes = unpack(r["sizes"], r["n"], np.uint8)
            raw = pa.decompress(r["pieces"], decompressed_size=int(sizes.sum(dtype=np.int64)), codec="zstd", asbytes=True)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            places.append(np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
            lows.append(unpack(r["least"], r["n"], np.int64))
            shard_of.append(unpack(r["shards"], r["n"], np.uint8))
        least, shard, bits_ = np.full(len(known), np.iinfo(np.int64).max), np.zeros(len(known), np.uint8), np.zeros(len(known), np.uint32)
        np.minimum.at(least, np.concatenate(places), np.concatenate(lows))
        shard[np.concatenate(places)] = np.concatenate(shard_of)
        pieces = list(known)
        del known
        some = met(pieces, length, part)
        for i in np.unique(shard[some]):
            mine = np.flatnonzero((shard == i) & some)
            bits_[mine] = shard_repeats([pieces[j] for j in mine.tolist()], least[mine], length)
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "n": t.column("n"), "bits": pa.array([pack(bits_[p]) for p in places], pa.binary()), "low": pa.array([pack(least[p]) for p in places], pa.binary()), "where": pa.array([None] * len(places), pa.binary())})

    def cut_out(left, right):
        import numpy as np
        import pyarrow as pa

        rows = unpack_rows(left.column("rows")[0].as_py())
        texts, ids = raw_texts(rows.column("t")), _ids(rows.column("k"))
        answers = right.to_pylist()
        here = next(r for r in answers if r["where"] is not None)
        row, x, c, bucket, place = unpack(here["where"], 5 * here["n"], np.int64).reshape(5, -1)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        base = ends - sizes
        hits, low = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        of = np.argsort(bucket, kind="stable")
        cuts = dict(zip(*np.unique(bucket[of], return_index=True), strict=True))
        for r in answers:
            if r["bits"] is not None:
                at = cuts[r["bucket"]]
                mine = of[at : at + np.searchsorted(bucket[of[at:]], r["bucket"], "right")]
                hits[mine], low[mine] = unpack(r["bits"], r["n"], np.uint32)[place[mine]], unpack(r["low"], r["n"], np.int64)[place[mine]]
        hits = np.where(ids[row] > low, (1 << c) - 1, hits).astype("<u4")
        nth, bit = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
        starts = base[row[nth]] + x[nth] + bit  # each place of the batch once at most
        step = np.zeros(int(sizes.sum()) + 1, np.int32)
        step[starts] += 1
        step[starts + length] -= 1
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if characters and len(raw):
            of = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)
            gone = np.bincount(of, gone)[of] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        begins = base[sizes > 0]
        first[begins] = gone[begins]
        removed, spans = (np.diff(np.append(0, np.cumsum(a, dtype=np.int32)[ends - 1] * (ends > 0))) for a in (gone, first)) if len(gone) else (0 * sizes, 0 * sizes)
        kept = raw[~gone].tobytes()
        offsets = np.append(0, np.cumsum(sizes - removed)).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).cast(pa.binary())
        through = rows.column("kept").combine_chunks()
        return pa.table({key: rows.column("k"), **{k: through.field(i) for i, k in enumerate(keep)}, "n_bytes": sizes, "n_removed": removed.astype(np.int64), "n_spans": spans.astype(np.int64), "kept": out})

    whole = batches.select("batch", "rows")
    asked = batches.select("batch", "rows").mapInArrow(ask, "bucket int, batch long, n long, keys binary, more binary, size binary")
    flags = settle(lambda: asked.groupBy("bucket").applyInArrow(meet, "batch long, bucket int, n long, flags binary"))
    sent = whole.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(send, "batch long, bucket long, n long, sizes binary, pieces binary, least binary, shards binary, where binary")
    repeats = settle(lambda: sent.groupBy("bucket").applyInArrow(sort, "batch long, bucket long, n long, bits binary, low binary, where binary"))
    schema = ", ".join([f"`{key}` {kinds[key]}", *(f"`{k}` {kinds[k]}" for k in keep), "n_bytes long, n_removed long, n_spans long, kept binary"])
    return whole.groupBy("batch").cogroup(repeats.groupBy("batch")).applyInArrow(cut_out, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Strings of bytes at every place are beyond SQL at this size: tested by brute force.
QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE: dict[str, str] = {}
