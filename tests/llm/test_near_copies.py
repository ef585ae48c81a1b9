"""The pipeline's near-copy stage against brute force."""

import random

import corpus_pipeline


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    ids = {}
    for (k, _), p in zip(rows, part, strict=True):
        ids.setdefault(p, []).append(k)
    return {min(x for x in ks if x is not None) for ks in ids.values() if any(k is not None for k in ks)}


def test_near_copies_of_every_similarity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line, texts = " ".join(word() for _ in range(12)), []
    for size in (3, 8, 30, 120, 700):
        for _ in range(6):
            base = [word() for _ in range(size)] + line.split() * (size > 100)
            for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
                texts.append(" ".join(word() if rng.random() < share else w for w in base))
    rng.shuffle(texts)
    rows = [*enumerate([*texts, None, "", " "]), (None, None), (None, texts[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(brute(rows))
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0
