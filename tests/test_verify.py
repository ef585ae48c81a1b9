import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web
from claimloom.operators import evaluate, evidence, gate, graph, signals

EVEREST = "Mount Everest is Earths highest mountain above sea level, with an elevation of 8,849 meters."
ELEVEN = "Numbers are 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 and then 11 in this long sentence."


def one(spark, claim, source, rules=signals.DEFAULT_RULES):
    return graph.verify(spark.createDataFrame([("x", claim, source)], "id string, claim string, evidence string"), rules).first()


@pytest.mark.parametrize(
    "claim, source, rules, decision, contradiction",
    [
        ("Mount Everest is 6848 meters tall.", EVEREST, signals.DEFAULT_RULES, "REJECT", 0.78),
        ("", EVEREST, signals.DEFAULT_RULES, "ABSTAIN", None),
        (None, None, signals.DEFAULT_RULES, "ABSTAIN", None),
        ("The value is 11 here", ELEVEN, signals.DEFAULT_RULES, "REJECT", 0.78),
        ("Jaws was directed by Steven Spielberg.", "Jaws is a 1975 thriller film directed by Steven Spielberg.", signals.DEFAULT_RULES, "ACCEPT", None),
        ("The harbor is not open today", "The harbor is open today", signals.EIGHT_RULES, "REJECT", 0.90),
        ("State College is a public university in the capital city", "State College is a private university in the capital city", signals.EIGHT_RULES, "REJECT", 0.82),
    ],
)
def test_decisions(spark, claim, source, rules, decision, contradiction):
    r = one(spark, claim, source, rules)
    assert r.decision == decision
    if contradiction is not None:
        assert r.contradiction_score == contradiction


def test_number_with_comma_is_found(spark):
    r = one(spark, "Mount Everest is 8849 meters tall.", EVEREST + " Mount Everest is located in the Himalayas.")
    assert r.decision != "REJECT"
    assert abs(r.evidence_coverage - 0.6) < 1e-9


def test_negation_keeps_punctuation(spark):
    r = one(spark, "The harbor is open today not.", "The harbor is open today", signals.EIGHT_RULES)
    assert "NEGATION_CONTRADICTION" not in [s.name for s in r.signals]


def test_text_functions(spark):
    df = spark.createDataFrame([("50% of 1,990,000, in 3D; 12.5%", "can't can’t Café")], "n string, t string")
    r = df.select(T.extract_numbers(F.col("n")).alias("n"), T.normalize_for_match(F.col("t")).alias("t"), T.ngrams(F.array(F.lit("a")), 5).alias("g")).first()
    assert r.n == ["50", "1990000", "12.5"]
    assert r.t == "can't cant caf"
    assert r.g == []


def test_claim_alignment(spark):
    df = spark.createDataFrame([("Sky is blue [1]. Sea is deep **today** [2]", ["u", "v", "w"])], "a string, c array<string>")
    assert df.select(web.align_claims(F.col("a"), F.col("c")).alias("x")).first().x == ["Sky is blue", "Sea is deep today", None]


def test_gate(spark):
    cases = {"a": [], "b": ["ACCEPT"] * 4, "c": ["ACCEPT"] * 3 + ["REVISE"], "d": ["ACCEPT", "ACCEPT", "REVISE", "REVISE"], "e": ["ACCEPT", "REJECT"]}
    answers = spark.createDataFrame([(k,) for k in cases], "k string")
    rows = spark.createDataFrame([(k, d) for k, ds in cases.items() for d in ds], "k string, decision string")
    assert dict(map(tuple, gate.gate(answers, rows, "k").collect())) == {"a": "ABSTAIN", "b": "ACCEPT", "c": "REVISE", "d": "ABSTAIN", "e": "REJECT"}


def test_calibration_leaves_one_out(spark):
    df = spark.createDataFrame([(0.0, True), (0.1, False), (0.95, True), (1.0, True), (None, True)], "confidence double, correct boolean")
    r = evaluate.calibration_error(df).first()
    assert r.scored == 5
    assert abs(r.ece - (1.0 + 0.1 + 0.05 + 0.5) / 5) < 1e-9


def test_both_window_forms_agree(spark):
    text = "The first sentence tells about rivers. The second sentence tells about lakes! A third one is about mountains and rivers? Short. Another sentence about rivers follows here."
    df = spark.createDataFrame([("x", "rivers and lakes are about mountains", text)], "id string, claim string, evidence string")
    df = df.withColumn("ss", T.split_sentences(F.col("evidence")))
    short = df.select(evidence.best_windows(T.token_set(F.col("claim")), F.col("ss"), T.token_sets(F.col("ss"))).alias("w")).first().w
    long = evidence.windows_long(df).orderBy("rank").collect()
    assert [(w.position, w.overlap) for w in short] == [(r.position, r.overlap) for r in long]


def test_long_windows_meet_blocks_and_shuffle_no_texts(spark):
    words = ["rivers", "lakes", "mountains", "valleys", "forests", "meadows", "harbors"]
    text = " ".join(f"Sentence {i} tells about {words[i % 7]} and {words[i * 3 % 5]} here." for i in range(23))
    cases = [("a", 1, "rivers and lakes are about mountains"), ("b", 1, "forests near meadows tell of harbors"), ("c", 1, "of"), ("d", 2, "rivers are about"), ("e", 3, "rivers are about"), ("f", 4, "nowhere named")]
    claims, sources = spark.createDataFrame(cases, "id string, of int, claim string"), spark.createDataFrame([(1, text), (2, "Rivers are about here and there."), (3, None)], "of int, evidence string")
    both = claims.join(sources, "of", "left")
    one = both.withColumn("ss", T.split_sentences(F.coalesce("evidence", F.lit("")))).select("id", evidence.best_windows(T.token_set(F.col("claim")), F.col("ss"), T.token_sets(F.col("ss"))).alias("w"))
    want = {(r.id, i + 1, w.position, w.coverage, w.overlap) for r in one.collect() for i, w in enumerate(r.w)}
    assert len(want) == 7
    for size in (1, 2, 5, 22, 23, 256):
        for got in (evidence.windows_long(both, size=size), evidence.windows_long_against(claims, sources, "of", size=size)):
            assert {(r.id, r["rank"], r.position, r.coverage, r.overlap) for r in got.collect()} == want
    plan = evidence.windows_long(both)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") and "lead(" not in plan  # windows are ranked as numbers, no sentences cross a shuffle


def test_stream_equals_batch(spark, tmp_path):
    from claimloom.streaming import verify_stream as V

    df = spark.createDataFrame([("a", "Mount Everest is 6848 meters tall.", EVEREST), ("b", "Seas are deep in many places", "Seas are deep in many places of the world.")], "id string, claim string, evidence string")
    df.write.parquet(str(tmp_path / "in"))
    q = V.verify_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).select("id", "decision").writeStream.format("memory").queryName("verified").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("verified").collect())) == sorted(map(tuple, graph.verify(df).select("id", "decision").collect()))


def test_white_space_of_any_script(spark):
    """No-break and other spaces are white space, as plain ones are."""
    claim, source = "old Paris tower stands", "There the old Paris tower stands today in the rain."
    plain, other = one(spark, claim, source), one(spark, claim, source.replace(" ", "\u00a0"))
    assert (plain.decision, plain.evidence_coverage) == (other.decision, other.evidence_coverage) == ("ACCEPT", 1.0)
    df = spark.createDataFrame([("\x1cNew\u00a0York  and\x85more\u3000",)], "t string")
    r = df.select(T.collapse(F.col("t")).alias("c"), T.extract_entities(F.col("t")).alias("e"), T.clip(F.col("t"), 10).alias("k"), T.extract_numbers(F.lit("\u0663\u0664 and 5")).alias("n")).first()
    assert (r.c, r.e, r.k, r.n) == ("New York and more", ["New\u00a0York"], "New Yor...", ["\u0663\u0664", "5"])


@pytest.mark.parametrize(
    "contradiction, coverage, support, want",
    [(0.78, 1.0, 1.0, "REJECT"), (0.77, 1.0, 1.0, "REVISE"), (0.0, 0.17, 1.0, "ABSTAIN"), (0.0, 0.18, 1.0, "REVISE"), (0.24, 0.74, 0.78, "ACCEPT"), (0.25, 0.74, 0.78, "REVISE"), (0.0, 0.73, 0.78, "REVISE"), (0.0, 0.74, 0.77, "REVISE")],
)
def test_gate_thresholds(spark, contradiction, coverage, support, want):
    df = spark.createDataFrame([(contradiction, coverage, support, "e", [])], "contradiction_score double, evidence_coverage double, support_score double, evidence_head string, windows array<struct<text:string>>")
    assert graph.decide(df).first().decision == want


@pytest.mark.parametrize("coverage, fires", [(0.54, False), (0.55, True), (0.56, True)])
def test_negation_threshold(spark, coverage, fires):
    df = spark.createDataFrame([("it is not so", "it is so", coverage, "p")], "claim_norm string, primary_norm string, coverage double, primary string")
    assert (df.select(signals.negation_contradiction().alias("s")).first().s is not None) == fires


@pytest.mark.parametrize("coverage, verdict", [(0.65, "SUPPORT"), (0.64, "NEUTRAL"), (0.18, "INSUFFICIENT"), (0.19, "NEUTRAL")])
def test_coverage_thresholds(spark, coverage, verdict):
    df = spark.createDataFrame([(coverage, "p")], "coverage double, primary string")
    assert df.select(signals.evidence_coverage().alias("s")).first().s.verdict == verdict


def test_graph_of_a_claim(spark):
    r = one(spark, "Jaws was directed by Steven Spielberg in 1975.", "Jaws is a 1975 thriller film directed by Steven Spielberg.")
    nodes, edges = {n.id: n for n in r.nodes}, {(e.source, e.target): e for e in r.edges}
    assert nodes["relation:directed-by-steven-spielberg-in-"].score == 1.0 and nodes["evidence:0"].detail.startswith("Jaws is a 1975") and nodes["source:0"].label == "source:0"
    assert edges["quantity:1975", "evidence:0"].label == "number match" and edges["entity:jaws", "evidence:0"].label == "entity match" and edges["source:0", "evidence:0"].label.endswith("% coverage")
    assert nodes["gate:0"].detail == f"risk={r.contradiction_score:.2f}"


def test_streams_of_gates_and_ids(spark, tmp_path):
    from claimloom.streaming import verify_stream as V

    rows = [("a", "x", "ACCEPT", "2024-01-01 00:01:00"), ("a", "x", "ACCEPT", "2024-01-01 00:01:00"), ("b", "x", "REJECT", "2024-01-01 00:02:00"), ("c", "y", "ACCEPT", "2024-01-01 00:03:00")]
    df = spark.createDataFrame(rows, "id string, answer_id string, decision string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("gates", V.gate_stream(stream), "complete"), ("fresh", V.fresh(stream), "append")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {r.answer_id: r.gate for r in spark.table("gates").collect()} == {"x": "REJECT", "y": "ACCEPT"}
    assert sorted(r.id for r in spark.table("fresh").collect()) == ["a", "b", "c"]
