"""URL filters: blocked Bloom filter of listed canonical URLs, then an exact hash join (operator 4)."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_enough, table

#: (host, path, verdict): the rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The query's list, a URL a line: the host names of unwanted kinds that the synthetic pages have (spam, pills, adult, casino,
#: betting, tracking). An operator's list is any table of urls.
LIST = Path(__file__).with_name("blocked_urls.txt")
BITS_PER_KEY = 16
PROBES = 6
#: A filter larger than this is not sent to executors; keys then go straight to the exact join.
FILTER_BYTES = 32 << 20
#: Rows of 64 bytes of the filter that one task makes.
SLICE_ROWS = 1 << 14


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`. Other parts are dropped."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    there = F.contains(url, F.lit("://"))
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without user, port and last dot; an empty path is /. For the list alone: rules see the url as it is."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return host, F.when((host != "") & (path == ""), "/").otherwise(path)


def filter_rows(n: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Rows (of 8 words of 64 bits, a cache line) of a filter of n keys."""
    return max(1, -(-n * bits_per_key // 512))


def bloom_words(hashes, rows: int, first: int = 0, last: int | None = None):
    """Rows first to last of a blocked Bloom filter with so many rows; a key sets PROBES bits in one row."""
    import numpy as np

    h = np.asarray(hashes, np.int64).view(np.uint64)
    filt = np.zeros(((rows if last is None else last) - first, 8), np.uint64)
    row, word, bit = _places(h, rows)
    for i in range(PROBES):
        np.bitwise_or.at(filt, (row - first, word[i]), bit[i])
    return filt


def _places(h, rows: int):
    import numpy as np

    row = ((h >> np.uint64(32)) * np.uint64(rows) >> np.uint64(32)).astype(np.int64)
    x = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    at = [(x >> np.uint64(9 * i)) & np.uint64(511) for i in range(PROBES)]
    return row, [(a >> np.uint64(6)).astype(np.int64) for a in at], [np.uint64(1) << (a & np.uint64(63)) for a in at]


def bloom_has(filt, hashes):
    import numpy as np

    h = np.asarray(hashes, np.int64).view(np.uint64)
    row, word, bit = _places(h, len(filt))
    out = np.ones(len(h), bool)
    for w, b in zip(word, bit, strict=True):
        out &= (filt[row, w] & b) != 0
    return out


def build_filter(entries: DataFrame, n: int):
    """The filter of entries' n hashes h: tasks make slices of it, the driver gets at most FILTER_BYTES."""
    import numpy as np

    rows = filter_rows(n)

    def make(t):
        import pyarrow as pa

        first = t.column("slice")[0].as_py() * SLICE_ROWS
        return pa.table({"slice": t.column("slice")[:1], "words": pa.array([bloom_words(t.column("h").to_numpy(), rows, first, min(rows, first + SLICE_ROWS)).tobytes()], pa.binary())})

    row = F.shiftrightunsigned("h", 32) * rows  # below 2**63 for any filter that is sent
    sliced = entries.select("h", F.floor(F.shiftrightunsigned(row, 32) / SLICE_ROWS).cast("int").alias("slice"))
    filt = np.zeros((rows, 8), np.uint64)
    for r in sliced.groupBy("slice").applyInArrow(make, "slice int, words binary").toLocalIterator():
        filt[r.slice * SLICE_ROWS : (r.slice + 1) * SLICE_ROWS] = np.frombuffer(r.words, np.uint64).reshape(-1, 8)
    return filt


def listed_urls(spark: SparkSession, path: str | Path = LIST) -> DataFrame:
    """(url) of a list file on the driver. Larger lists are any DataFrame of urls."""
    lines = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
    return spark.createDataFrame([(x,) for x in lines if x and not x.startswith("#")], "url string")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict.

    rules (host, path, verdict) and listed (url) name a host with its subdomains and a path prefix; listed urls are made
    canonical, and so is the page's url where it meets them. The longest rule that fits decides (by length of host and path, then
    of host); without one, a listed entry blocks and the rest is allowed. Every suffix of the host at a dot, with every path
    prefix as long as some entry's path, is a possible key; a blocked Bloom filter of all entries lets few through, and an exact
    join removes its false positives. Null, empty and broken urls have an empty host and path and are allowed; equal rows give
    equal results; null and broken entries never fit. Columns of other names are not read.
    """
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null").select("host", "path", "verdict", F.lit(0).alias("tier"))
    lh, lp = canonical(*host_path(F.col("url")))
    listed = listed.select(lh.alias("host"), lp.alias("path"), F.lit("block").alias("verdict"), F.lit(1).alias("tier")).where("host != ''")
    entries = rules.unionByName(listed).groupBy("host", "path", "tier").agg(F.max("verdict").alias("verdict")).withColumn("h", F.xxhash64("host", "path", "tier"))
    lens: dict[int, list[int]] = {0: [], 1: []}
    for tier, length in entries.select("tier", F.length("path").alias("n")).distinct().orderBy("tier", "n").collect():  # as many as a path has places
        lens[tier].append(length)
    host, path = host_path(F.col(url))
    seen = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), host.alias("host"), path.alias("path"))

    def keys(host: Column, path: Column, tier: int) -> Column:
        parts = F.split(host, r"\.")
        hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        prefixes = F.transform(F.filter(F.array(*map(F.lit, lens[tier])).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
        return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("kh"), p.alias("kp"), F.lit(tier).alias("kt"), F.xxhash64(h, p, F.lit(tier)).alias("h")))))

    ch, cp = canonical(F.col("host"), F.col("path"))
    seen = seen.withColumn("keys", F.concat(keys(F.col("host"), F.col("path"), 0), keys(ch, cp, 1)))
    n = entries.count()
    if n * BITS_PER_KEY // 8 <= FILTER_BYTES:
        filt = spark.sparkContext.broadcast(build_filter(entries, n))

        @F.pandas_udf("array<boolean>")
        def possible(hs: pd.Series) -> pd.Series:
            import numpy as np

            sizes = hs.map(len).to_numpy()
            flat = bloom_has(filt.value, np.concatenate([np.zeros(0, np.int64), *hs]))
            return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

        seen = seen.withColumn("may", possible(F.col("keys.h"))).withColumn("keys", F.filter("keys", lambda x, i: F.get("may", i)))
    hits = seen.select("row", "k", F.col("host").alias("own_host"), F.col("path").alias("own_path"), F.explode_outer("keys").alias("key"))
    hits = hits.select("row", "k", "own_host", "own_path", "key.kh", "key.kp", "key.kt")
    exact = entries.select("host", "path", "tier", "verdict")
    if small_enough(exact, F.octet_length("host") + F.octet_length("path") + 16):
        exact = F.broadcast(exact)
    hits = hits.join(exact, (F.col("kh") == F.col("host")) & (F.col("kp") == F.col("path")) & (F.col("kt") == F.col("tier")), "left")
    rank = F.struct(-F.col("tier"), F.length("host") + F.length("path"), F.length("host"))
    # a row's keys stand in one task, so the partial aggregate sends one line a row
    best = hits.groupBy("row").agg(F.first("k").alias("k"), F.first("own_host").alias("own_host"), F.first("own_path").alias("own_path"), F.max_by(F.struct("host", "path", "tier", "verdict"), F.when(F.col("host").isNotNull(), rank)).alias("best"))
    rule = F.when(F.col("best.tier") == 0, F.concat("best.host", "best.path"))
    return best.select(F.col("k").alias(key), F.col("own_host").alias("host"), F.col("own_path").alias("path"), rule.alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules, listed_urls(spark))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


def _list_lines() -> list[str]:
    return [x.strip() for x in LIST.read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")]


_HOST = "translate(regexp_extract({0}[strpos({0}, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}[strpos({0}, '://') + 3:], '^[^/?#]*([^?#]*)', 1)"
_CANON = r"regexp_replace(regexp_replace(regexp_replace({0}, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"

ORACLE = {
    "op4_url_filter": rf"""
with page as (select page_id, url, row_number() over () n,
    case when contains(url, '://') then {_HOST.format('url')} else '' end host,
    case when contains(url, '://') then {_PATH.format('url')} else '' end path from pages),
named as (select *, {_CANON.format('host')} ch from page),
canon as (select *, case when ch <> '' and path = '' then '/' else path end cp from named),
list as (select {_CANON.format(_HOST.format('u'))} h, {_PATH.format('u')} p from (values {_values((x,) for x in _list_lines())}) l(u)),
fit as (select n, h, p, v, 0 tier from canon join (values {_values(RULES)}) r(h, p, v) on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
    union all select n, h, p, 'block', 1 from canon join (select distinct h, case when p = '' then '/' else p end p from list where h <> '') l on (ch = h or ends_with(ch, '.' || h)) and starts_with(cp, p)),
best as (select * from fit qualify row_number() over (partition by n order by tier, len(h) + len(p) desc, len(h) desc) = 1)
select page_id, host, path, case when tier = 0 then h || p end rule, coalesce(v, 'allow') verdict from canon left join best using (n)"""
}
QUERIES = {"op4_url_filter": op4_url_filter}
