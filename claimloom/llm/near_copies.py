"""Groups of near copies at a word similarity: SimHash trie self-joins within shards of equal min-hashes, links verified exactly.

A Hamming budget wide enough for a similarity of 0.8 (texts of 0.8 differ in about 10 of 64 bits) prunes little of a trie of all
fingerprints: it would compare nearly all pairs. So the tries are dealt out by content: a shard holds sets that agree on the least
hashes of a band, which two sets of similarity s do with s**ROWS for each band. Within a shard the trie join is simhash.descend.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_values, small_enough
from .simhash import descend, in_blocks, link, name_components, ranges, shingle_hashes

SIZE = 5
SIMILARITY = 0.8
#: Sets meet where all ROWS least hashes of one of BANDS bands are equal: at a similarity of 0.8, 1 - (1 - 0.8**2)**8 = 0.9997 do.
BANDS = 8
ROWS = 2
#: Bits in which fingerprints of linked sets may differ: at 0.8, 9.7 on average with a deviation of 2.9.
BUDGET = 22
#: Rows in a task; a band value that more sets share is compared in parts.
SHARD_ROWS = 100_000
HOT = 10_000
EPS = 1e-9
#: Bits of a set's map of hashes: two maps differ in no more bits than their sets in elements.
MAP_BITS = 2048


def shingles(text: str | None, size: int):
    """The distinct shingle hashes, sorted."""
    import numpy as np

    return np.unique(shingle_hashes(text, size))


def node_of(hs) -> int:
    """One signed 64-bit name for equal sets; 0 for the empty one."""
    import xxhash

    x = xxhash.xxh64_intdigest(hs.tobytes()) if len(hs) else 0
    return x - (1 << 64) if x >> 63 else x


def bit_map(hs) -> bytes:
    import numpy as np

    bits = np.zeros(MAP_BITS, bool)
    bits[(hs % np.uint64(MAP_BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fingerprint_of(hs) -> int:
    """The SimHash of a set of hashes, signed."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hs), 65536):
        ones += np.unpackbits(hs[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(2 * ones > len(hs)).tobytes(), ">i8")[0])


def bands_of(hs, bands: int, rows: int) -> list[int]:
    """For each band one signed number of its least hashes under so many random orders."""
    import numpy as np

    if not len(hs):
        return [0] * bands
    rng = np.random.Generator(np.random.PCG64(77))
    out = []
    for i in range(bands):
        x = np.uint64(i + 1)
        for _ in range(rows):
            odd = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            low = (hs * odd).min()
            x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + low
        out.append(int(x.view(np.int64)))
    return out


def maybe(a, b, n, maps, similarity: float):
    """Which pairs of rows can be as similar: by their sizes, and by the bits in which their maps differ."""
    import numpy as np

    ok = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - EPS
    at = np.flatnonzero(ok)
    for part in np.array_split(at, len(at) // 100_000 + 1):
        i, j = a[part], b[part]
        apart = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
        ok[part] = apart <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + EPS
    return ok


def centres(u, group):
    """For each row the place of its group's row that is nearest to the group's majority of bits (rows sorted by group)."""
    import numpy as np

    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    major = np.zeros(len(first), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((u >> np.uint64(bit) & np.uint64(1)).astype(np.int64), first)
        major |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    far = np.bitwise_count(u ^ np.repeat(major, size))
    order = np.lexsort((far, group))
    return np.repeat(order[first], size)


def near_pairs(group, side, fp, node, part, n, maps, similarity: float, budget: int, first: bool):
    """Pairs of nodes of different parts in one group that may be as similar: fingerprints within the budget, sizes and maps alike.

    first: only spanning pairs of each with its group's centre and of neighbours by fingerprint; they join most of a dense group,
    so that the descent after it, which finds every pair, meets little but what is left.
    """
    import numpy as np

    u = fp.view(np.uint64)
    order = np.lexsort((u, side, group))
    group, side, u, node, n, maps = group[order], side[order], u[order], node[order], n[order], maps[order]
    _, comp = np.unique(part[order], return_inverse=True)
    found = [np.zeros((0, 2), np.int64)]

    def keep(a, b):
        ok = comp[a] != comp[b]
        a, b = a[ok], b[ok]
        ok = maybe(a, b, n, maps, similarity)
        found.append(np.sort(np.stack([node[a[ok]], node[b[ok]]], 1), axis=1))
        return a[ok], b[ok]

    def meet(a, b):
        keep(a, b)
        if sum(map(len, found)) > 4_000_000:
            found[:] = [np.unique(np.concatenate(found), axis=0)]
        return comp

    if not len(u):
        return found[0]
    if first:
        comp = np.arange(len(u))
        turned = np.lexsort((u << np.uint64(32) | u >> np.uint64(32), group))
        for a, b in ((centres(u, group), np.arange(len(u))), (np.arange(len(u) - 1), np.arange(1, len(u))), (turned[:-1], turned[1:])):
            ok = (group[a] == group[b]) & (np.bitwise_count(u[a] ^ u[b]) <= budget)
            comp = link(comp, *keep(a[ok], b[ok]))
    else:
        descend(u, comp, ranges(group, side), budget, meet)
    return np.unique(np.concatenate(found), axis=0)


def candidates(shared: DataFrame, similarity: float, budget: int, first: bool, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct pairs (a, b) of different parts that share a band and may be similar. shared: (s, node, fp, n, map, part)."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        group, side, fp, node, part, n = (t.column(c).to_numpy().copy() for c in ("block", "side", "fp", "node", "part", "n"))
        maps = np.frombuffer(b"".join(t.column("map").to_pylist()), np.uint64).reshape(-1, MAP_BITS // 64)
        pairs = near_pairs(group, side, fp, node, part, n, maps, similarity, budget, first)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    shards = max(1, -(-shared.count() // shard_rows))
    dealt = in_blocks(shared, "s", "node", HOT).select("node", "fp", "n", "map", "part", "block", "side", F.pmod("block", F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose sets, computed again from the texts, are as similar."""
    pairs = cut(pairs)

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            hs = [shingles(t.as_py(), size) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in hs], pa.int64()), pa.array([x.tobytes() for x in hs], pa.binary())], names=["node", "hs"])

    def check(batches):
        import numpy as np
        import pyarrow as pa

        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - EPS)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "h"), "node")
    used = cut(used.select("h").distinct())
    texts = docs.join(F.broadcast(used) if small_enough(used, F.lit(8)) else used, "h", "left_semi").dropDuplicates(["h"]).select("t")
    hs = cut(texts.mapInArrow(sets, "node long, hs binary").dropDuplicates(["node"]))
    two = pairs.join(hs.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(hs.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, budget: int = BUDGET) -> DataFrame:
    """(key, text_id, component_id) per row: rows link where the Jaccard similarity of their word shingle sets is at least similarity.

    Candidates are pairs that share a band and whose SimHashes are within the budget, so a pair is missed with a chance of less
    than one in a thousand; every link is verified on the whole sets. component_id is the least key reachable. Null and wordless
    texts are copies of each other. A null key is never least unless all of its component are null. Sets are told apart by 64-bit
    hashes; text_id is xxhash64(text). Other columns are not read.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))

    def prepare(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for t in b.column("t"):
                hs = shingles(t.as_py(), size)
                out.append((node_of(hs), len(hs), fingerprint_of(hs), bands_of(hs, bands, rows), bit_map(hs)))
            node, n, fp, ms, bits = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("h"), pa.array(node, pa.int64()), pa.array(np.array(n, np.int64)), pa.array(fp, pa.int64()), pa.array(ms, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["k", "h", "node", "n", "fp", "bands", "map"],
            )

    rowed = cut(docs.mapInArrow(prepare, f"k {dict(docs.dtypes)['k']}, h long, node long, n long, fp long, bands array<long>, map binary"))
    nodes = cut(rowed.groupBy("node").agg(F.min("k").alias("least"), F.count("*").alias("rows"), F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("n", "fp", "bands", "map")]))
    dealt = nodes.where("n > 0").select("node", "n", "fp", "map", F.explode("bands").alias("s"))
    several = dealt.groupBy("s").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = cut(join_values(dealt, cut(several), "s", "sets"))
    one = cut(verified(candidates(shared.withColumn("part", F.col("node")), similarity, budget, True), docs, nodes, size, similarity))
    parts = connected_components(one).withColumnRenamed("component", "part")
    left = shared.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    # a band value whose sets are in one part already has nothing left to find
    open_ = left.groupBy("s").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("s")
    left = cut(left.join(open_, "s", "left_semi"))
    two = verified(candidates(left, similarity, budget, False), docs, nodes, size, similarity)
    named = name_components(nodes.select("node", "least", "rows"), "node", connected_components(one.unionByName(two)))
    return join_values(rowed.select("k", "h", "node"), named, "node", "rows").select(F.col("k").alias(key), F.col("h").alias("text_id"), "component_id")
