"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 1, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, inner_name, small_enough, table

WINDOW = 10
#: Whatever is neither digit, lower-case ASCII letter nor outside ASCII separates words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), APART), ""), F.array().cast("array<string>"))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (gram, len, h, items): each item's windows of `window` words; a shorter item is one window; no words, none. A null id names no item, but its windows count."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window)))
    part = F.slice("w", F.col("at"), F.col("len"))
    grams = w.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at")).select("item", "len", F.array_join(part, " ").alias("gram"), F.xxhash64(part).alias("h"))
    return grams.groupBy("h", "gram", "len").agg(F.collect_set("item").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (key, text): k, text_id, copies, n_words, spans, items.

    copies counts equal rows; spans are merged [from, to) word ranges inside occurrences, in order; items are the sorted
    ids whose windows occur. Null or wordless texts have none; a null item id is in no list, but its words are hit. Grams go to every executor if
    their measured size is within the bound, else they are joined by a shuffle on their hash. A hash hit is verified on the words.
    Each text is one row that yields its windows as a stream, so a long text needs no more memory than its words.
    """
    grams = benchmark_grams(benchmark, window)
    lens = [r[0] for r in grams.select("len").distinct().orderBy("len").collect()]  # at most `window` numbers
    w = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("text_id"), words(F.col(text)).alias("w"))
    w = w.withColumn("n", F.size("w"))
    # row 0 of each text stands for the text itself and always stays
    n_lens = max(1, len(lens))
    sizes = F.array(*map(F.lit, lens or [window]))
    # a window of any length needs lens[0] words at least
    slots = F.when(F.col("n") >= (lens or [window])[0], F.col("n") * n_lens).otherwise(0)
    seq = w.select("k", "text_id", "w", "n", F.explode(F.sequence(F.lit(0), slots)).alias("i"))
    if n_lens == 1:
        at, size = F.col("i"), F.lit((lens or [window])[0])
    else:
        at, size = F.floor((F.col("i") + n_lens - 1) / n_lens).cast("int"), F.element_at(sizes, (F.pmod(F.col("i") - 1, F.lit(n_lens)) + 1).cast("int"))
    seq = seq.select("k", "text_id", "w", "n", "i", at.alias("at"), size.alias("size")).where("i = 0 or at + size <= n + 1")
    small = small_enough(grams, F.octet_length("gram") + F.size("items") * 24)
    rows = grams.select("h", "gram")
    rows = F.broadcast(rows) if small else rows
    part = F.slice("w", F.greatest("at", F.lit(1)), F.col("size"))
    # the words are compared where hashes meet; as "starts with" and equal length, so that the hash alone is the join's key
    gram = F.array_join(part, " ")
    same = F.startswith(gram, F.col("gram")) & (F.length(gram) <= F.length("gram"))
    seq = seq.withColumn("dh", F.when(F.col("i") > 0, F.xxhash64(part)))
    if not small:
        seq = seq.withColumn("w", F.when(F.col("i") > 0, part))
        gram = F.array_join("w", " ")
        same = F.startswith(gram, F.col("gram")) & (F.length(gram) <= F.length("gram"))
    met = seq.join(rows, (F.col("dh") == F.col("h")) & same, "left").where("gram is not null or i = 0")
    found = met.groupBy("k", "text_id").agg(
        F.max("n").alias("n_words"),
        F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("gram").isNotNull(), F.struct(F.col("at").alias("from"), (F.col("at") + F.col("size")).alias("to")))).alias("hits"),
        F.collect_set("gram").alias("grams"),
    )
    # merge ranges in order: a range that starts inside the last one extends it
    spans = F.aggregate(
        F.array_sort("hits"), F.array().cast("array<struct<from:int,to:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= s["from"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(acc, F.lit(-1))["to"], s["to"]).alias("to"))))).otherwise(F.concat(acc, F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))),
    )
    found = found.select("k", "text_id", "copies", "n_words", spans.alias("spans"), "grams")
    named = grams.select("gram", "items")
    named = F.broadcast(named) if small else named
    each = found.select("k", "text_id", "copies", "n_words", "spans", F.explode_outer("grams").alias("gram")).join(named, "gram", "left")
    return each.groupBy("k", "text_id").agg(F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_hit: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents of which a share of over min_hit of the words lies inside benchmark windows.

    Rows are judged alone; equal rows share their fate. Columns and their order stay; a null key is a key as any other.
    """
    bad = find_hits(docs, benchmark, window, key, text).where(n_hit() > F.lit(min_hit) * F.col("n_words"))
    c = inner_name(docs)
    bad = bad.select(F.col("k").alias(f"{c}k"), F.col("text_id").alias(f"{c}t"))
    return docs.join(bad, docs[key].eqNullSafe(F.col(f"{c}k")) & (F.xxhash64(docs[text]) == F.col(f"{c}t")), "left_anti")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["to"] - s["from"]))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    out = found.select(
        F.col("k").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[])"

ORACLE = {
    "op1_decontamination": f"""
with item as (select cast(item_id as varchar) item, {_WORDS.format('text')} w from benchmark),
sized as (select item, w, least(len(w), 10) n from item where len(w) > 0),
gram as (select item, n, array_to_string(w[i:i + n - 1], ' ') g from (select *, unnest(range(1, len(w) - n + 2)) i from sized)),
doc as (select doc_id, {_WORDS.format('text')} w from documents),
lens as (select distinct n from gram),
seen as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from doc, lens where len(w) >= n)),
hit as (select doc_id, seen.n, i, item from seen join gram on seen.n = gram.n and seen.g = gram.g),
word as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from hit) group by 1),
ids as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, item from hit where item is not null) group by 1)
select doc.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join word using (doc_id) left join ids using (doc_id)"""
}
QUERIES = {"op1_decontamination": op1_decontamination}
