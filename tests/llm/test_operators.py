"""Small fixtures and brute force for the training-data operators."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import bpe, classifier, common, decontam, language_id, lm_scoring, media, sharding, simhash, suffix_array, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, k string, fp string, batch string, _k string, _t string, _id string, _key string, _text string, component_id string, kept string, rows string"


def odd_rows():
    """Nulls, empty, long, tied and repeated rows; other columns have the operators' inner names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(4000))
    passage = "A passage of well over fifty bytes that two different texts have in common here."
    texts = [None, "", " ", "x", long, long, f"One {passage} two", f"Three {passage} four and {passage}", passage, "ab" * 400, "Straße ÉCOLE it's 12,5 <|endoftext|> Σίσυφος\x85end"]
    rest = tuple("kfbktikxcer")
    rows = [(i, t, "en" if i % 2 else None, *rest) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "null key with words in it", "en", *rest), (None,) * (3 + len(rest))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0])


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for names in (1, 2048):
        suffix_array.NAMES = names
        for _ in range(150):
            a = rng.choice([1, 2, 3, 20])
            s = [rng.randint(1, a) for _ in range(rng.randint(0, 60))] + [0]
            assert suffix_array.suffix_array(np.array(s), a + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), 1 << 62 if i is None else i
        for j in range(len(b) - n + 1):
            first[b[j : j + n]] = min(i, first.get(b[j : j + n], 1 << 62))
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < (1 << 62 if i is None else i):
                gone.update(range(j, j + n))
        yield i, len(b), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(bytes(c for j, c in enumerate(b) if j not in gone)).hexdigest()


@pytest.mark.parametrize("hot", [0, 1 << 20])
def test_suffix_dedup(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    got = suffix_dedup.remove_repeats(docs, batch_bytes=4000, bucket_bytes=6000).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_repeats([r[:2] for r in odd_rows()]), key=str)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_a_hot_anchor(spark):
    """At default settings: one passage in so many different texts that its anchors' strings exceed HOT_BYTES."""
    passage = "This passage of many more than fifty bytes stands in each of very many documents, "
    rng = random.Random(4)
    rows = [(i, f"{rng.random()} {rng.random()} " + passage + f"{rng.random()} {i % 7} and {passage[: 60 + i % 9]}") for i in range(16_000)]
    assert len(rows) * 50 * 2 > suffix_dedup.HOT_BYTES
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows))


def test_anchors_are_dealt_evenly(spark, monkeypatch):
    """Least hashes are low ones: buckets of equal width gave the first of 24 buckets over half of all anchors."""
    rng, flags, settle = random.Random(9), [], suffix_dedup.settle
    monkeypatch.setattr(suffix_dedup, "settle", lambda make: flags.append(settle(make)) or flags[-1])
    rows = [(i, "".join(rng.choices("abcdefghijklmnop", k=20_000))) for i in range(24)]
    assert suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=20_100).count() == 24
    n = [r[1] for r in flags[0].groupBy("bucket").agg(F.sum("n")).collect()]
    assert len(n) == 24 and max(n) < 1.5 * sum(n) / len(n)


def test_whole_characters_are_cut(spark):
    shared = "ß" * 30
    rows = [(0, "a" + shared), (1, "\ufffdé" + shared[:25] + "ä\ufffd")]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), characters=True).collect()}
    assert got == {0: rows[0][1], 1: "\ufffdé\ufffd"}  # the first byte of ä is that of ß, so it repeats too


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    spec = bpe.tokenizer_spec()
    t = Tokenizer.from_str(spec)
    want = []
    for r in odd_rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(r[0], bytes(r[1]), r[2]) for r in bpe.encode_decode(docs, spec, batch_bytes=2000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_decode(none, spec).count() == 0


def test_bpe_of_every_code_point():
    """Words of every code point, and random strings of them, have the library's ids."""
    codec = bpe.codec(bpe.tokenizer_spec())
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{chr(i)}B {chr(i)}" for i in points]
    rng = random.Random(5)
    apart = [*" \t\n\x0b\x0c\r\x1c\x85\xa0\u2003'", *"<|endoftext|>"]
    for _ in range(50_000):
        texts.append("".join(chr(rng.choice(points)) if rng.random() < 0.4 else rng.choice("aBéß'sSTΣ̧࣓́ۤW̊" if rng.random() < 0.7 else apart) for _ in range(rng.randint(1, 12))))
    texts += ["<|ENDOFTEXT|> a<|endoftext|>b <|startoftext|>", "", " "]
    kinds, word, bounds = bpe.split([t.encode() for t in texts])
    ids, sizes = codec.encode(kinds)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64)).tolist()
    ids, word, bounds = ids.tolist(), word.tolist(), bounds.tolist()
    for at in range(0, len(texts), 100_000):
        want = codec.tokenizer.encode_batch(texts[at : at + 100_000], add_special_tokens=False)
        for i, w in enumerate(want, at):
            assert [x for k in word[bounds[i] : bounds[i + 1]] for x in ids[ends[k] : ends[k + 1]]] == w.ids, ascii(texts[i])


def test_bpe_refuses_other_tokenizers():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.check_spec(bpe.tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json")))


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([("b", "four and a passage of well over fifty bytes that two different"), ("a", "OVER fifty bytes"), ("c", ""), ("d", None), (None, "x"), (None, None)], "item_id string, text string")
    got = {r.k: r for r in decontam.find_hits(docs, bench).collect() if r.k is not None}
    assert got[7]["items"] == ["a", "b"]
    assert [tuple(s) for s in got[8].spans] == [(1, 11)]
    assert got[6].copies == 2
    assert got[3]["items"] == [] and [tuple(s) for s in got[3].spans] == [(1, 2)] and got[0].n_words == 0
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {0, 1, 2, 4, 5, 9, 10, None}
    assert decontam.find_hits(none, bench).count() == 0
    assert decontam.find_hits(docs, bench.limit(0)).agg(F.sum("copies")).first()[0] == len(odd_rows())


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "https://example.com", "http://a.net/es/1", "http://spam-farm.example.org/p", "http://xspam-farm.example.org/p", "http://h.org/a://b",
            "http://spam-farm.example.org", "http://u:p@Spam-Farm.example.org.:80?x", "http://a.b.spam-farm.example.org:443/x", "http://other.org/listed/page", "http://other.org/list"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host int, row int")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block")], "host string, path string, verdict string")
    listed = url_filter.listed_urls(spark).unionByName(spark.createDataFrame([(None,), ("broken",), ("http://Other.org:80/listed",)], "url string"))
    got = sorted(map(tuple, url_filter.judge(pages, rules, listed).collect()))
    assert got[3] == (3, "www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [(g[3], g[4]) for g in got[4:9]] == [("example.com/en/", "block"), (None, "allow"), ("net/es/", "block"), (None, "block"), (None, "allow")]
    assert got[0][1:] == ("", "", None, "allow") and len(got) == 16 and got[9][1:3] == ("h.org", "/a://b")
    assert [g[4] for g in got[10:15]] == ["block", "block", "block", "block", "allow"] and got[11][1:3] == ("u:p@spam-farm.example.org.:80", "")
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    assert url_filter.judge(pages, rules.limit(0), listed.limit(0)).where("verdict != 'allow'").count() == 0


def test_url_filter_equals_sql(spark):
    from tests.oracle import compare

    assert compare(spark, "op4", url_filter.op4_url_filter, url_filter.ORACLE["op4_url_filter"], "/root/testdata/sf0.001") == ""
    assert url_filter.op4_url_filter(spark, "/root/testdata/sf0.01").where("rule is null and verdict = 'block'").count() > 0


def test_bloom_filter(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 50_000)
    f = url_filter.build_filter(spark.createDataFrame([(int(x),) for x in h], "h long"), len(h))
    assert (f == url_filter.bloom_words(h, url_filter.filter_rows(len(h)))).all()
    assert url_filter.bloom_has(f, h).all()
    assert url_filter.bloom_has(f, np.random.default_rng(2).integers(-(2**63), 2**63, 5000)).mean() < 0.05


def brute_model(spark, rows, learn):
    """Scores of the same model from plain dictionaries, with weights by expectation-maximisation on every held-out token by itself."""
    tok = lambda t: ["<", *(t or "").encode().lower().split(), "\n"]
    held = {r.t: r.d for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", lm_scoring.deleted(F.col("t")).alias("d")).collect()}
    count = {}
    for part in ("all", "rest"):
        ctx, pair, word = Counter(), Counter(), Counter()
        for k, t in rows:
            if learn(k) and (part == "all" or not held[t]):
                ws = tok(t)
                ctx.update(ws[:-1])
                word.update(ws[1:])
                pair.update(zip(ws, ws[1:]))
        count[part] = ctx, pair, word
    n, v, rest = sum(count["all"][2].values()), len(count["all"][2]), sum(count["rest"][2].values())
    by_class = {}
    ctx, pair, word = count["rest"]
    for k, t in rows:
        if learn(k) and held[t]:
            ws = tok(t)
            for a, b in zip(ws, ws[1:]):
                by_class.setdefault(ctx[a].bit_length(), []).append((pair[a, b] / max(ctx[a], 1), word[b] / max(rest, 1), 1 / (v + 1)))
    mix, last = {}, [0.0, 0.9, 0.1]
    for c in range(lm_scoring.CLASSES):
        if c in by_class:
            p, w = np.array(by_class[c]), np.array([0.4, 0.4, 0.2])
            for _ in range(lm_scoring.ROUNDS):
                share = p * w
                w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
            w = np.maximum(w, 1e-6)
            last = w / w.sum()
            if c == 0:
                last = np.append(0, last[1:] / last[1:].sum())
        elif c == 0:
            last = [0, 0.9, 0.1]
        mix[c] = last
    ctx, pair, word = count["all"]
    for k, t in rows:
        ws = tok(t)
        yield k, len(ws) - 1, sum(word[w] > 0 for w in ws[1:]), n, sum(np.log10((word[w] + 1) / (n + v + 1)) for w in ws[1:]), sum(
            np.log10(mix[ctx[a].bit_length()] @ np.array([pair[a, b] / max(ctx[a], 1), word[b] / max(n, 1), 1 / (v + 1)])) for a, b in zip(ws, ws[1:])
        )


def test_lm_scoring(spark, docs, none):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]
    rows = [r[:2] for r in odd_rows()] + [(100 + i, " ".join(vocabulary[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(1, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 2
    got = sorted(map(tuple, lm_scoring.score_texts(df, learn, batch_bytes=4000, bucket_bytes=9000).collect()), key=str)
    want = sorted(brute_model(spark, rows, lambda k: (k or 0) % 3 != 2), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[4] - w[4]) < 1e-6 * (1 + abs(w[4]))
        assert abs(g[5] - w[5]) < 0.005 * abs(w[5]) + 0.01  # cells of like estimates stand for their tokens
    assert lm_scoring.score_texts(none, F.lit(True)).count() == 0
    assert lm_scoring.score_texts(docs, F.lit(None).cast("boolean"), keep=("lang",)).where("n_known > 0 or score != 0").count() == 0


def test_mixture_prefers_pairs_that_tell():
    mix = lm_scoring.learn_mixture(np.array([3 << 40, (3 << 40) + 1]), np.array([90, 10]), np.array([45.0, 0.0]), np.array([90.0, 10.0]), 1000, 100)
    assert mix[3, 0] > 0.7 and np.allclose(mix.sum(axis=1), 1)


def test_simhash_links(docs, none):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 120)).astype(np.uint64), axis=0) for k in (2, 4, 6)])).view(np.int64)
    spark = docs.sparkSession
    for hot in (20_000, 3):
        links = simhash.links(spark.createDataFrame([(int(x),) for x in fp], "fp long"), hot=hot)
        got = {r.node: r.component for r in common.connected_components(links, one_task=0 if hot == 3 else None).collect()}
        u, group = fp.view(np.uint64), {int(x): int(x) for x in fp}
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
        for _ in range(len(fp)):
            new = {int(x): min(group[int(y)] for y in fp[near[i]]) for i, x in enumerate(fp)}
            if new == group:
                break
            group = new
        assert {x: got.get(x, x) for x in group} == group
    assert simhash.near_duplicates(none).count() == 0


def brute_components(keys, near):
    """The least key (null last) reachable from each row."""
    part = list(range(len(keys)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = part[i], part[j]
        part = [min(a, b) if p in (a, b) else p for p in part]
    return [min((k for k, q in zip(keys, part, strict=True) if q == p and k is not None), default=None) for p in part]


@pytest.mark.parametrize("hot", [10_000, 4])
def test_near_duplicates(docs, hot, monkeypatch):
    if hot == 4:  # keys are joined by broadcast, components found in rounds
        for name, value in (("HOT_SHARE", 1 << 30), ("HOT_ROWS", 1), ("ONE_TASK_LINKS", 0)):
            monkeypatch.setattr(common, name, value)
    rng = random.Random(2)
    rows = [r[:2] for r in odd_rows()]
    for i in range(60):
        base = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 300))]
        rows += [(200 + 10 * i + j, " ".join(w if rng.random() > 0.004 * j else "new" for w in base)) for j in range(4)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fp = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    want = brute_components([k for k, _ in rows], np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(str, ((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got))) == sorted(map(str, ((k, int(f), c) for (k, _), f, c in zip(rows, fp, want, strict=True))))


def test_blocks_meet_every_pair(spark):
    rows = spark.range(100).select(F.lit(7).alias("g"), F.col("id").alias("fp")).unionByName(spark.createDataFrame([(8, 1000), (8, 1001)], "g int, fp long"))
    met = set()
    for block in simhash.in_blocks(rows, "g", "fp", 30).groupBy("g", "block").agg(F.collect_list(F.struct("fp", "side")).alias("r")).collect():
        sides = {s: [r.fp for r in block.r if r.side == s] for s in (0, 1)}
        assert len(block.r) < 90
        met |= {(min(a, b), max(a, b)) for a in sides[0] for b in (sides[1] or sides[0]) if a != b}
    assert met == {(a, b) for b in range(100) for a in range(b)} | {(1000, 1001)}


def test_fingerprint_by_hand():
    import xxhash

    words = b"a b c d e".split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(2)]
    assert simhash.fingerprint("A b\tc d\x0be") == hs[0] & hs[1]


def test_shards(docs, none):
    from zlib import crc32

    rows = [(r[0], len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode())) for r in odd_rows()]
    got = sharding.byte_shards(docs, 3, range_rows=4).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, rows))
    inorder = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, at, want, slots = sum(r[1] for r in rows), 0, [], Counter()
    for k, size, crc in inorder:  # the part of all bytes in which a row's middle lies
        shard = min(2, (2 * at + size) * 3 // (2 * total))
        want.append((k, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    sums = Counter()
    for _, size, _, shard, _ in want:
        sums[shard] += size
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r[1] for r in rows)
    assert sharding.byte_shards(none).count() == 0


def test_language_id(docs, none):
    spark = docs.sparkSession
    train = spark.createDataFrame([("the cat and the dog sat in the house", "en"), ("der hund und die katze im haus", "de"), (None, "de"), ("x", None)], "text string, lang string")
    p = language_id.train(train)
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(1, "the dog and the house"), (2, "die katze und der hund"), (3, "12 !"), (4, None)], "doc_id long, text string"), p).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert got[1].score > 0.5 and got[3].score == 0
    assert language_id.predict(docs, {}).where("lang_pred != 'und'").count() == 0
    assert language_id.predict(none, p).count() == 0 and language_id.train(none) == {}


def test_language_of_held_out_documents(spark):
    """At most one in fifty labelled documents that the model did not learn from is told wrong; texts without letters are `und`."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    got = language_id.op8_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id")
    right, n = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 150 and right >= 0.98 * n
    assert got.where("lang_pred = 'und' and text rlike '[A-Za-z]'").count() == 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_quality_classifier(spark, docs, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(4))
    rows = [(i, " ".join([*(word() for _ in range(40)), *(["scum"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows if i % 2 == 0 or i % 3 == 0], "doc_id long, quality int, toxic int")
    held = {i: x for i, _, x in rows if i % 2 and i % 3}
    kept = {r.doc_id: r.kept for r in classifier.judge(df, labels).collect()}
    good, bad = [kept[i] for i, x in held.items() if not x], [kept[i] for i, _, x in rows if x]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.12 * len(bad)
    assert classifier.judge(docs, labels.limit(0)).where("kept").count() == len(odd_rows())
    assert classifier.judge(docs, labels).where("doc_id < 3 and not kept").count() == 0
    assert classifier.judge(none, labels).count() == 0


def test_labels_with_nulls(spark):
    labels = spark.createDataFrame([(1, None, 1), (2, 0, None), (3, 1, 0), (3, None, None), (4, 1, None), (None, 0, 1), (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, classifier.sides(labels, 100).collect())) == [(1, False), (2, False), (3, True), (5, False)]
    assert classifier.sides(labels, 2).count() == 2


def test_model_ratios_have_either_sign(spark):
    rows = [(f"plain words here {'fine' if i % 4 else 'scum'}", i % 4 > 0) for i in range(400)]
    w, level = classifier.fit(spark.createDataFrame(rows, "text string, side boolean"), F.col("side"))
    of = lambda t: float(w[classifier.buckets(t, ngram=1)[0]].sum())
    assert of("scum") < -3 and of("fine") > 0.2 and of("unseen") == 0
    # repeats count
    s = {r.text: r.scores[0] for r in classifier.score(spark.createDataFrame([("scum",), ("scum scum x scum",)], "text string"), (w, level), keep=("text",)).collect()}
    assert s["scum scum x scum"] < 2.9 * s["scum"]


def test_gumbel_top_k(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("score"))
    assert classifier.gumbel_top_k(df, 137, F.col("id"), 1.0).where("sampled").count() == 137


def brute_matches(prints, queries, max_error, min_overlap):
    """Every pair of recordings with its least error over all offsets, if that is within the bound."""
    out = {}
    for q in queries:
        for m in range(len(prints)):
            a, b = prints[m], prints[q]
            errors = [e for o in range(-len(b) + 1, len(a)) if (e := media.error_at(a, b, o, min_overlap)) is not None]
            if errors and min(errors) <= max_error:
                out[q, m] = min(errors)
    return out


@pytest.mark.parametrize("audio, vector", [(0.02, 0.0), (0.1, 0.0), (0.0, 0.01), (0.02, 0.03)])
def test_media_recall_against_brute_force(spark, audio, vector):
    """At production parameters: noisy and overlapping copies that alignment at every offset finds are found, but for one in ten at most; nothing else is."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    rows = [v.tolist() for v in base] + [(v + rng.normal(0, vector * np.abs(v).max(), 64)).tolist() for v in base] + [[*v[20:].tolist(), *rng.uniform(-1, 1, 20).tolist()] for v in base[:20]]
    decode = lambda k, x: media.render(x, noise=audio, seed=k)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(4)
    prints = [media.chroma_fingerprint(decode(k, x)) for k, x in enumerate(rows)]
    queries = range(0, len(rows), 4)
    want = brute_matches(prints, queries, media.MAX_ERROR, media.MIN_OVERLAP)
    got = {(r["query"], r["match"]): r.bit_error for r in media.search(df, decode, lambda k: k % 4 == 0, "vec_id", "embedding").collect()}
    assert set(got) <= set(want) and len(want) > 35
    assert len(got) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_media_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64).tolist()
    rows = [("a", base), ("b", [*rng.normal(size=8).tolist(), *base[:56]]), ("c", rng.normal(size=64).tolist()), ("d", base), ("e", None), ("f", []), (None, base), ("g", [None, 1.0]), ("h", base[:9])]
    df = spark.createDataFrame(rows, "id string, wave array<double>")
    got = {(r["query"], r["match"]): r for r in media.search(df, lambda k, x: media.render(x), lambda k: k.isin("a", "h"), "id", "wave").collect()}
    assert got["a", "a"].members == 2 and got["a", "a"].bit_error == 0 and ("a", "c") not in got and got["a", "b"].offset == 8
    assert not any("h" in k for k in got)  # fewer integers than have to overlap
    assert media.search(df.limit(0), lambda k, x: media.render(x), lambda k: k == "a", "id", "wave").count() == 0
    dealt = media.votes(spark.createDataFrame([(1, [7, 9])], "q long, keys array<long>"), spark.createDataFrame([(i, [7, 6, 200]) for i in range(50)], "c long, keys array<long>"), hot=10)
    assert {(r.q, r.offset, r.votes) for r in dealt.collect()} == {(1, 0, 1), (1, 1, 1)} and dealt.count() == 100
