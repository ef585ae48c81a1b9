"""SimHash near-duplicates by a binary trie self-join under a Hamming error budget (operator 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, join_values, small_enough, table

BUDGET = 4
SHINGLE = 4
SEED = 42
#: Shards of tries: about so many fingerprints in a task; a prefix with more is dealt out by further bits.
SHARD_ROWS = 100_000
HOT_PREFIX = 20_000
#: Node pairs expanded at once, and pairs of ranges compared leaf by leaf.
FRONT = 200_000
LEAF = 32


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED):
    """XXH64 of each word shingle, repeats included; the whole text is one shingle if it has no more words than that."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hash_, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([hash_(line, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return np.fromiter((hash_(line[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(words) - size + 1)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits: each is 1 if set in over half the XXH64 of the word shingles, repeats included; 0 without words."""
    import numpy as np

    hs = shingle_hashes(text, size, seed)
    if not len(hs):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hs), 65536):  # a long text is summed in parts
        ones += np.unpackbits(hs[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hs)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(k, fp long) for each row; null and wordless texts have 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column("t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fps)], names=["k", "fp"])

    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return docs.mapInArrow(run, f"k {dict(docs.dtypes)['k']}, fp long")


def _blocks(bits: list[int], pieces: int) -> list[int]:
    """The bits dealt into so many runs, as masks (signed)."""
    cuts = [round(i * len(bits) / pieces) for i in range(pieces + 1)]
    masks = [sum(1 << x for x in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def child_masks(mask: int, budget: int) -> list[int]:
    """mask with one of budget + 1 blocks of the other bits: fingerprints within the budget agree on one of them."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | m for m in _blocks(rest, budget + 1) if m] if len(rest) > budget else []


def link(comp, a, b):
    """comp (a root for each row) after rows a[i] and b[i] are joined; roots are least places."""
    import numpy as np

    while len(a):
        ra, rb = comp[a], comp[b]
        far = ra != rb
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        if not len(a):
            break
        np.minimum.at(comp, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = comp[comp]
            if (up == comp).all():
                break
            comp = up
    return comp


def descend(u, comp, starts, budget: int, meet):
    """Walks pairs of trie nodes down from `starts` (arrays of two ranges each) over u, which is sorted within each range.

    A trie node is a range of sorted fingerprints. A pair goes down a bit at a time, gains an error where it takes different bits,
    and is dropped over the budget, or once all rows of both nodes have one root in comp. Where nodes are small, meet(a, b) gets
    the pairs of rows within the budget that have different roots, and returns comp as it then is.
    """
    import numpy as np

    n = len(u)
    zeros = {}

    def split(lo, hi, depth):
        if depth not in zeros:
            zeros[depth] = np.append(0, np.cumsum(1 - (u >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64)))
        return lo + zeros[depth][hi] - zeros[depth][lo]

    stack = [(0, *starts, np.zeros(len(starts[0]), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            stack += [(depth, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]), (depth, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half])]
            continue
        change = np.append(0, np.cumsum(np.append(0, comp[1:] != comp[:-1])[:n]))  # changes before place i
        one = lambda lo, hi: change[hi] - change[np.minimum(lo + 1, n)] == 0
        live = (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, err = (x[live] for x in (alo, ahi, blo, bhi, err))
        done = one(alo, ahi) & one(blo, bhi) & (comp[alo] == comp[blo])
        alo, ahi, blo, bhi, err = (x[~done] for x in (alo, ahi, blo, bhi, err))
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth == 64)
        if small.any():
            a0, an, b0, bn = alo[small], (ahi - alo)[small], blo[small], (bhi - blo)[small]
            reps = an * bn
            at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            a, b = np.repeat(a0, reps) + at // np.repeat(bn, reps), np.repeat(b0, reps) + at % np.repeat(bn, reps)
            ok = (a != b) & (np.bitwise_count(u[a] ^ u[b]) <= budget) & (comp[a] != comp[b])
            comp = meet(np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok]))
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm, same = split(alo, ahi, depth), split(blo, bhi, depth), alo == blo
        more = ~same
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), (am[more], ahi[more], blo[more], bm[more], err[more] + 1)]
        alo, ahi, blo, bhi, err = map(np.concatenate, zip(*parts, strict=True))
        ok = (err <= budget) & (ahi > alo) & (bhi > blo)
        stack.append((depth + 1, alo[ok], ahi[ok], blo[ok], bhi[ok], err[ok]))
    return comp


def ranges(group, side):
    """The trie roots to compare among rows sorted by (group, side): a group's one side with itself, or its first side with its second."""
    import numpy as np

    if not len(group):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
    last = np.append(first[1:], len(group))
    of = group[first]
    two = np.append(of[1:] == of[:-1], False)
    alone = ~two & ~np.append(False, two[:-1])
    a, b = np.flatnonzero(two), np.flatnonzero(two) + 1
    return tuple(np.concatenate([x[alone], x[y]]) for x, y in ((first, a), (last, a), (first, b), (last, b)))


def trie_links(group, side, fp, budget: int = BUDGET):
    """Spanning links (fp, root's fp) of rows within the budget in one group, between its two sides if it has two."""
    import numpy as np

    u = fp.view(np.uint64)
    order = np.lexsort((u, side, group))
    group, side, u = group[order], side[order], u[order]
    n, comp = len(u), np.arange(len(u))
    # neighbours in a few rotated orders join most of a dense group before the descent
    for turn in (0, 16, 32, 48):
        turned = u if not turn else u << np.uint64(turn) | u >> np.uint64(64 - turn)
        o = np.lexsort((turned, group))
        a, b = o[:-1], o[1:]
        ok = (group[a] == group[b]) & (np.bitwise_count(u[a] ^ u[b]) <= budget)
        comp = link(comp, a[ok], b[ok])

    def meet(a, b):
        nonlocal comp
        comp = link(comp, a, b)
        return comp

    comp = descend(u, comp, ranges(group, side), budget, meet)
    moved = np.flatnonzero(comp != np.arange(n))
    return u[moved].view(np.int64), u[comp[moved]].view(np.int64)


def in_blocks(rows: DataFrame, key: str, row: str, hot: int) -> DataFrame:
    """rows with `block` and `side`: the rows of a key, or of two parts of a hot key, so that no block has over about 2 * hot rows.

    A hot key's rows are dealt by the hash of `row` to parts of about `hot` rows, and each two parts meet in a block (side 0 and
    1); a part meets itself alone (side 0). Every pair of a key's rows meets in one block.
    """
    many = rows.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(cut(many)), key, "left")  # at most one row for each `hot` rows
    part = F.pmod(F.xxhash64(row), F.coalesce("parts", F.lit(1))).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j"), (part > j).cast("int").alias("side")))
    rows = rows.withColumn("m", F.explode(meets))
    return rows.withColumns({"block": F.xxhash64(key, "m.i", "m.j"), "side": F.col("m.side")}).drop("m", "parts")


#: Times a hot block value is dealt out again by other bits before its rows are compared part by part.
LEVELS = 3


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT_PREFIX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints fp: two within the budget are connected by links, whatever the group's size.

    The tries are dealt out by prefix: two fingerprints within the budget agree on one of budget + 1 blocks of bits. A block
    value that too many share (a dense group) is dealt out again by the blocks of the other bits, LEVELS times at most; what is
    still hot is compared in parts, each two of them in a task of their own.
    """
    from functools import reduce

    level = {m: child_masks(m, budget) for m in child_masks(0, budget)}
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, level))).alias("mask"))
    ready = []
    for depth in range(LEVELS + 1):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if depth == LEVELS or not all(level.values()):
            ready.append(rows)
            break
        many = cut(rows.groupBy("mask", "key").count().where(F.col("count") > hot).select("mask", "key"))
        if many.isEmpty():
            ready.append(rows)
            break
        side = F.broadcast(many) if small_enough(many, F.lit(16)) else many
        ready.append(rows.join(side, ["mask", "key"], "left_anti"))
        kids = F.create_map(*[x for m, c in level.items() for x in (F.lit(m), F.array(*map(F.lit, c)))])
        rows = rows.join(side, ["mask", "key"], "left_semi").select("fp", F.explode(kids[F.col("mask")]).alias("mask")).distinct()
        level = {m: child_masks(m, budget) for c in level.values() for m in c}
    rows = cut(reduce(DataFrame.unionByName, ready).select("fp", F.xxhash64("mask", "key").alias("g")))  # a shared hash only compares more
    n = max(1, -(-rows.count() // shard_rows))

    def run(t):
        import pyarrow as pa

        a, b = trie_links(t.column("block").to_numpy(), t.column("side").to_numpy(), t.column("fp").to_numpy().copy(), budget)
        return pa.table({"a": a, "b": b})

    dealt = in_blocks(rows, "g", "fp", hot).select("fp", "block", "side", F.pmod("block", F.lit(n)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(key, fp, component) per row: rows link where fingerprints differ in at most budget bits; component is the least key reachable.

    Equal fingerprints are one node, so copies never make pairs; nodes of hot fingerprints and components are joined back by
    broadcast. Null and wordless texts share fingerprint 0. A null key is never least unless all of its component are null.
    Repeated rows stay rows. Other columns are not read.
    """
    fps = cut(fingerprints(docs, key, text, size))
    nodes = cut(fps.groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("rows")))
    named = name_components(nodes, "fp", connected_components(links(nodes.select("fp"), budget)))
    return join_values(fps, named, "fp", "rows").select(F.col("k").alias(key), "fp", "component_id")


def name_components(nodes: DataFrame, node: str, parts: DataFrame) -> DataFrame:
    """(node, component_id, rows) of nodes (node, least, rows) and their components: the least key of all a component's nodes."""
    nodes = cut(nodes.join(parts.withColumnRenamed("node", node), node, "left").select(node, "least", "rows", F.coalesce("component", node).alias("part")))
    least = cut(nodes.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    return cut(join_values(nodes.select(node, "rows", "part"), least, "part", "n").select(node, "component_id", "rows"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: XXH64 and components are beyond SQL: tested by brute force.
QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
