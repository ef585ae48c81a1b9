"""Experiments, model seams, tensors, tables and the command line, on small inputs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom import cli
from claimloom.operators import evaluate as V
from claimloom.operators import experiments as X
from claimloom.operators import models as M
from claimloom.operators import graph, signals, tensors
from claimloom.sources import io, tables

EVEREST = "Mount Everest is Earths highest mountain above sea level, with an elevation of 8,849 meters. Mount Everest is located in the Himalayas."


def test_bootstrap_is_the_multinomial_of_counts(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    p = np.where(rng.random(400) < 0.8, y, 1 - y)
    df = spark.createDataFrame([("d", int(a), int(b)) for a, b in zip(y, p, strict=True)], "dataset string, label int, pred int")
    got = X.bootstrap_ci(df, "dataset").first()
    bacc = []
    for _ in range(1000):  # rows resampled one by one
        i = rng.integers(0, 400, 400)
        a, b = y[i], p[i]
        bacc.append(((b[a == 0] == 0).mean() + (b[a == 1] == 1).mean()) / 2)
    low, high = np.percentile(bacc, [2.5, 97.5])
    assert got.n == 400 and abs(got.low - low) < 0.01 and abs(got.high - high) < 0.01
    assert tuple(X.bootstrap_ci(df, "dataset").first()) == tuple(got)
    assert tuple(X.bootstrap_ci(df.limit(0)).first()) == (0, 0.0, 0.0)


def test_top_signal(spark):
    s = lambda n, v, x: (n, v, x)
    rows = [([s("a", "SUPPORT", 0.9), s("b", "CONTRADICT", 0.3), s("c", "CONTRADICT", 0.3)],), ([s("a", "NEUTRAL", 0.2), s("b", "SUPPORT", 0.2)],), ([],)]
    df = spark.createDataFrame(rows, "signals array<struct<name:string,verdict:string,score:double>>")
    assert [r.t for r in df.select(X.top_signal(F.col("signals")).alias("t")).collect()] == ["b", "a", None]


def test_chunks(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    sizes = {}
    for n in (0, 1, 400, 401, 600, 649, 650, 1000):
        sizes[n] = [len(c.split()) for c in spark.createDataFrame([(words(n),)], "t string").select(X.token_chunks(F.col("t")).alias("c")).first().c]
    assert sizes == {0: [0], 1: [1], 400: [400], 401: [400, 201], 600: [400, 400], 649: [400, 400, 249], 650: [400, 400, 250], 1000: [400, 400, 400, 400]}


def test_tiers_need_the_same_ids(spark):
    a = spark.createDataFrame([(1, True, 1), (2, False, 1)], "id int, decided boolean, pred int")
    assert sorted(map(tuple, V.compose_tiers(a, a.select("id", F.lit(0).alias("pred"))).collect())) == [(1, 1, "tier1"), (2, 0, "tier2")]
    with pytest.raises(ValueError):
        V.compose_tiers(a, a.where("id = 1"))


def test_ablation_leaves_one_out(spark):
    rows = [("1", "Mount Everest is located in the Himalayas", EVEREST, 1), ("2", "Mount Everest is 6848 meters tall.", EVEREST, 0), ("3", "Nothing of the kind was ever said", "Short.", 0)]
    got = {(r.variant, r.view): r for r in X.ablation(spark.createDataFrame(rows, "id string, claim string, evidence string, label int")).collect()}
    assert {v for v, _ in got} == {"full", *signals.DEFAULT_RULES} and len(got) == 12
    assert got["full", "decided"].n_decided == 2 and got["full", "decided"].balanced_accuracy == 1.0 and got["full", "accept"].coverage == pytest.approx(2 / 3)


def test_prediction_analysis(spark):
    s, u, v = "SUPPORTED", "UNSUPPORTED", "UNVERIFIABLE"
    df = spark.createDataFrame([(u, u, 0.9), (u, s, 0.4), (s, u, 0.8), (s, s, None), (v, u, 0.2)], "predicted string, expected string, confidence double")
    r = V.prediction_analysis(df).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.abstention_rate, r.coverage_conditioned_accuracy, r.far) == (1, 1, 1, 1, 0.2, 0.5, 0.5)
    sweep = {round(x.threshold, 2): (x.tp, x.fp, x.fn, x.tn) for x in V.prediction_sweep(df).collect()}
    assert sweep[0.0] == (1, 1, 1, 1) and sweep[0.5] == (1, 0, 1, 2) and sweep[1.0] == (0, 0, 2, 2) and len(sweep) == 21


def test_views_and_resume(spark):
    r = spark.createDataFrame([(i, "UNSUPPORTED" if i % 2 else "SUPPORTED", "SUPPORTED") for i in range(120)], "id int, predicted string, expected string")
    assert [x.id for x in X.view(r, "wrong", 1, 50).collect()] == list(range(101, 120, 2)) and X.view(r, "unreachable").count() == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "id string, n int, v string")
    assert [tuple(x) for x in X.rebuilt(spark.createDataFrame([("a",), ("b",)], "id string"), rows, "id", "n").collect()] == [("a", "z")]
    assert X.limited(r, 3, "id").count() == 3 and X.limited(r, 0, "id").count() == 120


def entail():
    """A stub that entails what shares most words."""

    def score(t: pd.DataFrame) -> pd.DataFrame:
        share = [len(set(p.lower().split()) & set(h.lower().split())) / max(1, len(h.split())) for p, h in zip(t["premise"], t["hypothesis"], strict=True)]
        return pd.DataFrame({"entailment": share, "contradiction": [0.9 if "not" in p.split() else 0.0 for p in t["premise"]]})

    return score


def says(answers):
    """A stub of a text model: the answer of the first key that the prompt has."""

    def load():
        return lambda t: pd.DataFrame({"text": [next((a for k, a in answers.items() if k in p), "") for p in t["prompt"]]})

    return load


def test_model_scores(spark):
    pairs = spark.createDataFrame([("1", "the sea is deep", "the sea is deep " + "x " * 500), ("2", "a b", "not a b")], "id string, claim string, evidence string")
    got = {r.id: (r.entailment, r.contradiction) for r in M.pair_scores(pairs, entail).collect()}
    assert got == {"1": (1.0, 0.0), "2": (1.0, 0.9)}
    trip = {r.id: r for r in M.roundtrip(pairs, says({"sea": "Rewrite: the sea is not deep", "a b": ""}), entail).collect()}
    assert trip["1"].score == pytest.approx(1.0 * 1.0 * 0.25) and trip["2"].score == 0.5 and trip["2"].rewrite == ""
    parts = {r.id: r for r in M.decomposed(pairs, says({"sea": "1. the sea is deep\n2. nothing of that sort", "a b": ""}), entail).collect()}
    assert parts["1"].n_atoms == 2 and parts["1"].min_entailment == 0.0 and parts["1"].score == pytest.approx(0.4 * 0.5) and parts["2"].n_atoms == 1


def test_tiers_with_a_model(spark):
    runs = spark.createDataFrame([("1", "d", 1, 1, 0.9, True), ("2", "d", 0, 0, 0.1, False)], "id string, dataset string, label int, pred int, score double, decided boolean")
    asked = []

    def second(rest):
        asked.append({r.id for r in rest.collect()})
        return M.thresholded(rest.select("id", F.lit(0.7).alias("s")), "s", 0.5)

    got = {r.id: (r.pred, r.decided, r.tier) for r in M.tiered(runs, second, "nli").collect()}
    assert asked == [{"2"}] and got == {"1": (1, True, "signals"), "2": (1, True, "nli")}


def test_generation_is_verified_and_written_again(spark):
    q = spark.createDataFrame([("1", EVEREST, "How tall is it?"), ("2", EVEREST, "Where is it?")], "id string, context string, question string")
    write = says({"not supported": "Mount Everest is located in the Himalayas today.", "How tall": "Mount Everest is 6848 meters tall today.", "Where": "Mount Everest is located in the Himalayas."})
    load = lambda: (lambda t, f=write(): f(t).rename(columns={"text": "answer"}))
    got = {r.id: r for r in M.generate_verified(q, load).collect()}
    assert got["1"].regenerations == 1 and got["1"].raw_answer.startswith("Mount Everest is 6848") and "Himalayas" in got["1"].final_answer and not got["1"].blocked
    assert got["2"].regenerations == 0 and got["2"].n_unsupported == 0
    wrong = lambda: (lambda t: pd.DataFrame({"answer": ["Mount Everest is 6848 meters tall today."] * len(t)}))
    assert {r.id: (r.blocked, r.final_answer) for r in M.generate_verified(q, wrong).collect()} == {"1": (True, ""), "2": (True, "")}
    fixed = lambda: (lambda t: pd.DataFrame({"claim": ["Mount Everest is located in the Himalayas." if "flagged" in p else "Mount Everest is 6848 meters tall." for p in t["prompt"]]}))
    r = M.repaired(spark.createDataFrame([("1", "p", EVEREST)], "id string, prompt string, evidence string"), fixed).first()
    assert r.revised and r.decision == "ACCEPT"


def test_risk_bias(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0], 0.5), ([1.0] * 4, 0.62), ([1.0] * 4, 3.0)], "s array<double>, risk double")
    got = [r.x for r in df.select(M.risk_bias(F.col("s"), F.col("risk"), [1, 9], [2]).alias("x")).collect()]
    assert got[0] == [1.0] * 4 and got[1] == pytest.approx([1.0, 2.24, 1.744, 1.0]) and got[2] == pytest.approx([1.0, 3.0, 2.2, 1.0])


def test_alignment(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [("1", "claim", 0, "sea", e(1, 0), True), ("1", "claim", 1, "deep", e(0, 1), True), ("1", "source", 0, "sea", e(1, 0), True), ("1", "source", 1, "deep", e(0, 1), True), ("2", "claim", 0, "the", e(1, 0), False), ("2", "source", 0, "x", e(1, 0), True), ("3", "claim", 0, "8849", e(1, 0), True)]
    tokens = spark.createDataFrame(rows, "id string, side string, pos int, token string, vec array<double>, content boolean")
    pairs = spark.createDataFrame([("1", "sea deep", "sea deep"), ("2", "the", "x"), ("3", "8849", "no number")], "id string, claim string, evidence string")
    got = {r.id: (round(r.score, 6), r.verdict) for r in M.alignment(tokens, pairs).collect()}
    assert got == {"1": (1.0, "SUPPORT"), "2": (0.5, "NEUTRAL"), "3": (0.25, "CONTRADICT")}


def test_graph_tensors(spark):
    nodes = [("claim:0", "claim", "c", 0.5), ("source:0", "source", "s", 1.0)]
    df = spark.createDataFrame([(1, nodes, [("claim:0", "source:0", 0.7), ("claim:0", "gone", 1.0)], 0.6, 0.2), (2, [], [], 0.0, 0.0)], "id int, nodes array<struct<id:string,kind:string,label:string,score:double>>, edges array<struct<source:string,target:string,weight:double>>, s double, c double")
    r, empty = df.select("id", tensors.feature_rows(F.col("nodes"), F.col("s"), F.col("c")).alias("f"), tensors.edge_index(F.col("nodes"), F.col("edges")).alias("e")).orderBy("id").collect()
    import hashlib

    want = np.zeros(64)
    want[7] = 1
    want[int(hashlib.sha256(b"s").hexdigest()[:8], 16) % 64] += 0.5
    want[-3:] = 1.0, 0.6, 0.2
    assert np.allclose(r.f[1], want) and [tuple(e) for e in r.e] == [(0, 1, 0.7)] and empty.f == [[0.0] * 64] and empty.e == []
    vecs = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [2.0, 0.0]), (2, 1, [4.0, 2.0])], "case int, pos int, vec array<double>")
    m = {(x["case"], x.pos): x.message for x in tensors.message_pass(vecs, spark.createDataFrame([(1, 0, 1, 0.5)], "case int, src int, dst int, weight double")).collect()}
    assert m == {(1, 0): [0.0, 0.0], (1, 1): [0.5, 1.0], (2, 0): [3.0, 1.0], (2, 1): [3.0, 1.0]}
    h = 4
    rng = np.random.default_rng(1)
    w = {"node_w": rng.normal(size=(h, 64)), "node_b": np.zeros(h), "norm_w": np.ones(h), "norm_b": np.zeros(h), "message_w": rng.normal(size=(h, h)), "message_b": np.zeros(h), "gate_w": rng.normal(size=(h, h)), "gate_b": np.zeros(h), "risk_w": np.zeros((1, h)), "risk_b": np.zeros(1)}
    cases = df.select("id", F.array_repeat(F.lit(1.0), h).alias("hidden"), tensors.feature_rows(F.col("nodes"), F.col("s"), F.col("c")).alias("features"), tensors.edge_index(F.col("nodes"), F.col("edges")).alias("edges"))
    out = {x.id: x for x in tensors.adapter(cases, w).collect()}
    assert len(out) == 2 and out[1].risk == 0.5 and len(out[1].adapted) == h and np.isfinite(out[2].adapted).all()


def test_tables_and_runs(spark, tmp_path):
    folder = str(tmp_path)
    m = spark.createDataFrame([("a", "x", 0.5), ("a", "y", None), ("b", "x", 0.8125)], "dataset string, system string, balanced_accuracy double")
    tables.write_table(spark, folder, "breakdown", ["Dataset", "x", "y"], tables.breakdown_rows(m, ["x", "y"]))
    assert (tmp_path / "breakdown.md").read_text() == "| Dataset | x | y |\n|---|---|---|\n| a | 50.0 | nan |\n| b | 81.2 | nan |\n"
    s = spark.createDataFrame([("tiered", 0.673, 0.66, 0.69, 0.162, 0.491, 1.0, 75.55, 139012345.0)], "system string, bacc double, low double, high double, far double, frr double, coverage double, ms_per_claim double, params double")
    tables.write_table(spark, folder, "headline", tables.HEADLINE, tables.headline_rows(tables.union_summaries(None, s)))
    assert "tiered & 67.3 & [66.0, 69.0] & 16.2 & 49.1 & 100.0 & 75.55 & 139,012,345 \\\\" in (tmp_path / "headline.tex").read_text() and "95\\% CI" in (tmp_path / "headline.tex").read_text()
    rows = spark.createDataFrame([("1", "d", 1, 1, 0.5, True, "s", "t", 1.0)], io.RUN)
    tables.write_run(spark, folder, "signals", rows, s, "hash", "abc", "2024-01-01")
    assert json.loads((tmp_path / "signals.manifest.json").read_text())["dataset_hash"] == "hash" and json.loads((tmp_path / "signals.summary.json").read_text())["system"] == "tiered"
    assert [tuple(r) for r in io.load_runs(spark, f"{folder}/signals.jsonl").collect()] == [tuple(r) for r in rows.collect()]
    with open(tmp_path / "broken.jsonl", "w") as f:
        f.write('{"id": "1", "label": 1}\nnot json\n')
    assert io.load_runs(spark, f"{folder}/broken.jsonl").count() == 1


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("c", "d", 1, "s", 7), ("e", "f", 0, "s", 3)], "claim string, doc string, label long, dataset string, n long")
    assert [r.id for r in io.as_pairs(rows, "test", "n", 1).collect()] == ["test-3"]
    pairs = io.as_pairs(rows, "test", "n")
    io.snapshot(pairs, str(tmp_path / "s"))
    io.snapshot(pairs.limit(0), str(tmp_path / "s"))
    assert io.load_pairs(spark, str(tmp_path / "s")).count() == 2
    import hashlib

    assert io.dataset_hash(pairs, "id") == hashlib.sha256(b"test-3e0test-7c1").hexdigest()[:16]
    assert io.dataset_digest(pairs.repartition(5)).collect() == io.dataset_digest(pairs.coalesce(1)).collect()
    sig = [("n", "l", "v", 0.5, 0.1, "r", "e")]
    out = io.export_results(spark.createDataFrame([(1, "c", "u", "SUPPORTED", "k"), (2, "c", "u", "SUPPORTED", "k")], "id int, claim string, url string, expected string, category string"), spark.createDataFrame([(1, "SUPPORTED", 0.9, 1, sig)], "id int, predicted string, confidence double, tier int, signals array<struct<name:string,label:string,verdict:string,score:double,weight:double,rationale:string,evidence:string>>"))
    assert [(r.id, [tuple(s) for s in r.signals]) for r in out.collect()] == [(1, [("n", "v", 0.5, 0.1)])]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e.txt").write_text(EVEREST)
    assert cli.main(["verify", "--claim", "Mount Everest is 6848 meters tall.", "--evidence-file", str(tmp_path / "e.txt")], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["decision"] == "REJECT" and "nodes" not in out
    assert cli.main(["graph", "--claim", "Mount Everest is tall", "--evidence", EVEREST], spark) == 0
    assert {"nodes", "edges"} <= set(json.loads(capsys.readouterr().out))
    assert cli.main(["verify", "--claim", "x"], spark) == 2
    (tmp_path / "b.json").write_text(json.dumps([{"claim": "Mount Everest is 6848 meters tall.", "evidence": EVEREST, "expected": "UNSUPPORTED"}, {"claim": "x", "evidence": "y", "expected": "SUPPORTED"}]))
    assert cli.main(["bench", str(tmp_path / "b.json"), "--limit", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["unsupported_rejected"] == 1


def test_signal_accuracy_asks_nothing_below_its_sums(spark):
    rows = [("a", True, 1, 1), ("a", True, 0, 1), ("b", False, 1, 1), (None, True, 1, 1)]
    runs = spark.createDataFrame(rows, "signal string, decided boolean, pred int, label int").withColumn("signal", F.get(F.filter(F.array("signal"), lambda s: F.length(s) > 0), F.lit(0)))
    out = X.signal_accuracy(runs)
    assert [tuple(r) for r in out.collect()] == [("a", 1, 2, 0.5, False)]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]


def test_node_features_sum_places_without_a_row_a_place(spark):
    nodes = [("claim:0", "claim", "c", 0.5), ("source:0", "source", "s", 1.0)]
    df = spark.createDataFrame([(1, nodes, 0.6, 0.2), (2, [], 0.0, 0.0)], "id int, nodes array<struct<id:string,kind:string,label:string,score:double>>, s double, c double")
    f = df.select(tensors.feature_rows(F.col("nodes"), F.col("s"), F.col("c")).alias("f"))
    out = tensors.place_sums(f)
    got, want = {r.place: (r.x, r.n) for r in out.collect()}, np.array([row for r in f.collect() for row in r.f]).sum(0)
    assert len(got) == 64 and all(n == 3 for _, n in got.values()) and np.allclose([got[i][0] for i in range(64)], want)
    assert tensors.place_sums(f.where("false")).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and plan.index("posexplode") < plan.index("Aggregate") and plan.count("sha2") == 1


def test_ablation_builds_the_graph_once(spark):
    rows = [("1", "Mount Everest is located in the Himalayas", EVEREST, 1), ("2", "Mount Everest is 6848 meters tall.", EVEREST, 0), ("3", "Nothing of the kind was ever said", "Short.", 0), ("4", EVEREST, EVEREST, 1), ("5", None, None, 0)]
    ready = graph.with_signals(graph.prepare(spark.createDataFrame(rows, "id string, claim string, evidence string, label int"))).withColumn("label", F.col("label") + 0)
    each = ready.withColumn("variant", F.explode(F.array(F.lit("full"), *map(F.lit, signals.DEFAULT_RULES)))).withColumn("signals", F.filter("signals", lambda s: s["name"] != F.col("variant")))
    want = X.run_rows(graph.decide(graph.build_graph(each))).select("variant", "label", "pred", "decided")
    assert sorted(map(tuple, X.without_each(ready).collect())) == sorted(map(tuple, want.collect()))
    plan = V.abstention_views(X.without_each(ready), "variant")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("entity missing") == 1 and "Join" not in plan
    assert plan.rindex("Generate explode") < plan.index("entity missing")  # the graph stands below the variants
