"""Packed batches of documents that ask buckets about their keys.

A batch is one row: some megabytes of whole rows as one compressed Arrow stream, made where the rows are read and written once, so
texts move compressed and a lost task finds the same batches again. A batch sends each bucket its distinct keys there as one
packed, sorted list, so a key met very often in the corpus still costs a batch one entry, and a bucket answers in the batch's own
order. Buckets cut the key space into parts of as many keys; their number follows the input's bytes. There are never more lists than distinct keys.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Text in a batch, and text whose keys one bucket looks after.
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20


def packed(docs: DataFrame, text: str = "t", lane: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, lane, n, bytes, rows): docs' rows in batches of about batch_bytes of text, rows of one lane (an int) together, written out.

    A longer text is a batch of its own. rows is read by unpack_rows. Null texts count as empty.
    """
    names = docs.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def emit(of: int):
            nonlocal made
            rows = pa.Table.from_batches(held.pop(of)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)
            made += 1
            return pa.RecordBatch.from_pydict({"batch": pa.array([first + made], pa.int64()), "lane": pa.array([of], pa.int32()), "n": pa.array([rows.num_rows], pa.int64()), "bytes": pa.array([size.pop(of)], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for b in batches:
            lanes = b.column(lane).to_numpy(zero_copy_only=False) if lane else np.zeros(b.num_rows, np.int64)
            for of in np.unique(lanes).tolist():
                part = b.filter(pa.array(lanes == of))
                ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy().astype(np.int64) + 16)
                at, base = 0, 0
                while at < part.num_rows:
                    room = batch_bytes - size.get(of, 0)
                    end = max(at + 1, int(np.searchsorted(ends, base + room, "right")))
                    held.setdefault(of, []).append(part.slice(at, end - at))
                    size[of] = size.get(of, 0) + int(ends[end - 1]) - base
                    at, base = end, int(ends[end - 1])
                    if size[of] >= batch_bytes or at < part.num_rows:
                        yield emit(of)
        for of in list(held):
            yield emit(of)

    return cut(docs.select(*names).mapInArrow(run, "batch long, lane int, n long, bytes long, rows binary"))


def unpack_rows(blob: bytes):
    """The rows of one batch, as a table in one chunk."""
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def volume(batches: DataFrame) -> int:
    """Bytes of text in packed batches."""
    return batches.agg(F.sum("bytes")).first()[0] or 0


def buckets_of(total: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-total // bucket_bytes))


def key_bits(total: int, spare: int) -> int:
    """So many bits that of all keys that total bytes of text can hold, one in 2**spare has another's."""
    return min(64, max(40, int(total).bit_length() + spare))


def pack(a) -> bytes:
    """A numeric array, byte planes apart, compressed."""
    import numpy as np
    import pyarrow as pa

    a = np.ascontiguousarray(a)
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, n: int, dtype):
    import numpy as np
    import pyarrow as pa

    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(b, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def pack_sorted(keys) -> bytes:
    """Sorted unsigned 64-bit keys, as differences."""
    import numpy as np

    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes, n: int):
    import numpy as np

    return np.cumsum(unpack(b, n, np.uint64), dtype=np.uint64)


def bucket_bounds(keys, buckets: int, bits: int = 64):
    """Where each bucket's part of sorted keys of so many bits begins; the last bound is their number."""
    import numpy as np

    of = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(of, np.arange(buckets + 1))


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """cut(make()), then a hint to let go of the shuffle files behind it, which Spark else keeps until the driver collects garbage.

    Results never depend on the hint; without it the files stay on disk for longer.
    """
    df = make()
    jvm, out = df.sparkSession.sparkContext._jvm, cut(df)
    del df
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
    return out
