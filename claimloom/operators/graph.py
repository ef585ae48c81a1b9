"""Claim verification: windows, signals, evidence graph and decision, one narrow projection over (id, claim, evidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T

from . import evidence as E
from . import signals as S


def prepare_claims(df: DataFrame) -> DataFrame:
    """Adds what is read off the claim alone. A null claim counts as empty."""
    df = df.withColumn("claim", F.coalesce("claim", F.lit("")))
    c = F.col("claim")
    df = df.withColumns({"claim_tokens": T.tokenize(c), "claim_norm": T.normalize_for_match(c), "claim_numbers": T.extract_numbers(c), "claim_entities": T.extract_entities(c), "relations": T.extract_relations(c)})
    return df.withColumn("claim_set", F.array_distinct("claim_tokens"))


def prepare_evidence(df: DataFrame) -> DataFrame:
    """Adds what is read off the evidence alone, so that a source with many claims is read once. Null evidence counts as empty."""
    df = df.withColumn("evidence", F.coalesce("evidence", F.lit("")))
    e = F.col("evidence")
    df = df.withColumns({"evidence_length": F.length(e), "evidence_head": F.substring(e, 1, 900), "evidence_norm": T.normalize_for_match(e), "evidence_numbers": T.extract_numbers(e), "sentences": T.split_sentences(e)})
    return df.withColumn("sentence_sets", T.token_sets(F.col("sentences")))


#: What prepare_evidence adds; the evidence itself need not go on.
EVIDENCE = ("evidence_length", "evidence_head", "evidence_norm", "evidence_numbers", "sentences", "sentence_sets")


def meet(df: DataFrame) -> DataFrame:
    """Windows, and what is read off the best of them, of rows with prepared claim and evidence."""
    df = df.withColumn("windows", E.best_windows(F.col("claim_set"), F.col("sentences"), F.col("sentence_sets")))
    df = df.withColumn("primary", F.coalesce(F.get("windows", F.lit(0))["text"], F.substring("evidence_head", 1, 700)))
    return df.withColumns({
        "primary_norm": T.normalize_for_match(F.col("primary")), "primary_numbers": T.extract_numbers(F.col("primary")), "coverage": T.share(T.token_set(F.col("primary")), F.col("claim_set")),
        "evidence_coverage": F.coalesce(F.get("windows", F.lit(0))["coverage"], F.lit(0.0)),
    })


def prepare(pairs: DataFrame) -> DataFrame:
    """pairs (id, claim, evidence, ...) ready for rules."""
    return meet(prepare_claims(prepare_evidence(pairs)))


def with_signals(prepared: DataFrame, rules=S.DEFAULT_RULES) -> DataFrame:
    """Adds `signals`. rules: names in the registry, or functions that return a nullable signal column."""
    made = F.array(*[(S.RULES[r] if isinstance(r, str) else r)() for r in rules])
    return prepared.withColumn("signals", F.array_compact(made))


def _edge(source: Column, target: Column, kind: Column, weight: Column, label: Column) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), kind.alias("kind"), weight.cast("double").alias("weight"), label.alias("label"))


def _node(id_: Column, kind: str, label: Column, score: Column, detail: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), score.cast("double").alias("score"), (F.lit("") if detail is None else detail).alias("detail"))


def edge_scores(edges: Column, report_support: Column, report_contradiction: Column) -> tuple[Column, Column]:
    """(support, contradiction) of a graph: what its edges say, where that is more than the signals' own scores."""
    for_it = F.filter(edges, lambda e: e["kind"].isin("supports", "grounds"))
    mean = T.let(for_it, lambda up: F.aggregate(up, F.lit(0.0), lambda a, e: a + e["weight"]) / F.greatest(F.size(up).cast("double"), F.lit(1.0)))
    against = F.aggregate(edges, report_contradiction, lambda a, e: F.greatest(a, F.when(e["kind"] == "contradicts", e["weight"]).when(e["kind"] == "attenuates", e["weight"] * 0.45).otherwise(0.0)))
    return F.greatest(report_support, mean), F.least(F.lit(1.0), against)


def build_graph(df: DataFrame, source_id: str | Column = "source:0") -> DataFrame:
    """Adds nodes, edges, support_score, contradiction_score. Edges keep order and repeats; of nodes with one id the first stays.

    source_id is the label of the source's node.
    """
    L = F.lit
    claim, first = L("claim:0"), L("evidence:0")
    df = df.withColumns({"rel_text": F.coalesce(F.get("windows", L(0))["text"], "evidence_head"), "report_support": S.support_score(F.col("signals")), "report_contradiction": S.contradiction_score(F.col("signals"))})
    df = df.withColumn("rel_tokens", F.when(F.size("relations") > 0, T.token_set(F.col("rel_text"))))
    # each named thing of the claim with its node, and whether the evidence has it
    df = df.withColumns({
        "entity_items": F.transform("claim_entities", lambda x, i: F.struct(x.alias("x"), T.node_id("entity", x, i).alias("id"), F.contains(F.col("evidence_norm"), T.normalize_for_match(x)).alias("found"))),
        "number_items": F.transform("claim_numbers", lambda x, i: F.struct(x.alias("x"), T.node_id("quantity", x, i).alias("id"), F.array_contains("evidence_numbers", x).alias("found"))),
        "relation_items": F.transform("relations", lambda x, i: F.struct(x.alias("x"), T.node_id("relation", x, i).alias("id"), T.share(F.col("rel_tokens"), T.token_set(x)).alias("score"))),
        "loud": F.filter(F.transform("signals", lambda s, i: F.struct(s.alias("s"), F.concat(L("signal:"), F.lower(s["name"]), L(":"), i.cast("string")).alias("id"))), lambda x: x["s"]["verdict"] != "NEUTRAL"),
    })
    ev = lambda i: F.concat(L("evidence:"), i.cast("string"))
    kind_of = lambda s: F.when(s["verdict"] == "SUPPORT", "supports").when(s["verdict"] == "CONTRADICT", "contradicts").otherwise("attenuates")
    edges = F.flatten(F.array(
        F.array(_edge(claim, L("source:0"), L("cites"), L(1.0), L("cites"))),
        F.flatten(F.transform("windows", lambda w, i: F.array(_edge(L("source:0"), ev(i), L("contains"), w["overlap"], F.concat(T.percent(w["coverage"]), L(" coverage"))), _edge(ev(i), claim, F.when(w["coverage"] >= 0.62, "grounds").otherwise("routes"), w["coverage"], L("grounds claim"))))),
        F.flatten(F.transform("entity_items", lambda x: F.array(_edge(claim, x["id"], L("mentions"), L(0.9), L("mentions")), _edge(x["id"], first, F.when(x["found"], "grounds").otherwise("attenuates"), F.when(x["found"], 0.9).otherwise(0.35), F.when(x["found"], "entity match").otherwise("entity missing"))))),
        F.flatten(F.transform("number_items", lambda x: F.array(_edge(claim, x["id"], L("mentions"), L(0.9), L("uses number")), _edge(x["id"], first, F.when(x["found"], "grounds").otherwise("contradicts"), F.when(x["found"], 0.9).otherwise(0.78), F.when(x["found"], "number match").otherwise("number missing"))))),
        F.flatten(F.transform("relation_items", lambda x: F.array(_edge(claim, x["id"], L("mentions"), L(0.8), L("relation")), _edge(x["id"], first, F.when(x["score"] >= 0.7, "grounds").otherwise("routes"), x["score"], L("relation evidence"))))),
        F.transform("loud", lambda x: _edge(x["id"], claim, kind_of(x["s"]), x["s"]["score"] * x["s"]["weight"], F.lower(x["s"]["verdict"]))),
    ))
    df = df.withColumn("edges", F.filter(edges, lambda e: ~F.isnan(e["weight"])))
    support, against = edge_scores(F.col("edges"), F.col("report_support"), F.col("report_contradiction"))
    df = df.withColumns({"support_score": support, "contradiction_score": against})
    nodes = F.flatten(F.array(
        F.array(_node(claim, "claim", T.clip(F.col("claim")), F.col("report_support")), _node(L("source:0"), "source", L(source_id) if isinstance(source_id, str) else source_id, L(1.0))),
        F.transform("windows", lambda w, i: _node(ev(i), "evidence", F.concat(L("Evidence window "), (i + 1).cast("string")), w["coverage"], w["text"])),
        F.transform("entity_items", lambda x: _node(x["id"], "entity", x["x"], F.when(x["found"], 1.0).otherwise(0.25))),
        F.transform("number_items", lambda x: _node(x["id"], "quantity", x["x"], F.when(x["found"], 1.0).otherwise(0.2))),
        F.transform("relation_items", lambda x: _node(x["id"], "relation", T.clip(x["x"], 90), x["score"])),
        F.transform("loud", lambda x: _node(x["id"], "signal", x["s"]["label"], x["s"]["score"], x["s"]["rationale"])),
        F.array(_node(L("gate:0"), "gate", L("Gate"), F.col("support_score"), F.concat(L("risk="), F.format_string("%.2f", F.bround("contradiction_score", 2))))),
    ))
    once = T.let(nodes, lambda ns: T.let(F.transform(ns, lambda x: x["id"]), lambda ids: F.filter(ns, lambda x, i: F.array_position(ids, x["id"]) == i + 1)))
    df = df.withColumns({"nodes": once, "edges": F.concat("edges", F.array(_edge(claim, L("gate:0"), L("routes"), F.col("support_score"), L("release control"))))})
    return df.drop("rel_text", "rel_tokens", "entity_items", "number_items", "relation_items", "loud")


def decision(con: Column, cov: Column, sup: Column) -> Column:
    """The first rule that holds decides."""
    return F.when(con >= 0.78, "REJECT").when(cov < 0.18, "ABSTAIN").when((sup >= 0.78) & (cov >= 0.74) & (con < 0.25), "ACCEPT").otherwise("REVISE")


def decide(df: DataFrame) -> DataFrame:
    """Adds risk, decision, status, confidence, excerpt, reason."""
    con, cov, sup = F.col("contradiction_score"), F.col("evidence_coverage"), F.col("support_score")
    df = df.withColumn("risk", F.least(F.lit(1.0), con + F.greatest(F.lit(0.0), F.lit(0.55) - cov) * 0.3))
    df = df.withColumn("decision", decision(con, cov, sup))
    d = F.col("decision")
    return df.withColumns({
        "status": F.when(d == "ACCEPT", "SUPPORTED").when(d == "REJECT", "UNSUPPORTED").otherwise("UNVERIFIABLE"),
        "confidence": F.greatest(sup, F.when(d == "ACCEPT", 1 - F.col("risk")).otherwise(F.col("risk"))),
        "excerpt": F.coalesce(F.get("windows", F.lit(0))["text"], F.substring("evidence_head", 1, 240)),
        "reason": F.when(d == "REJECT", "High-confidence contradiction edge reached the gate.").when(d == "ABSTAIN", "Evidence graph does not cover enough of the claim.").when(d == "ACCEPT", "Claim is grounded by the strongest evidence window.").otherwise("Evidence is partial or mixed; regenerate with stricter grounding."),
    })


def verify(pairs: DataFrame, rules=S.DEFAULT_RULES) -> DataFrame:
    """pairs (id, claim, evidence, ...) with the full result of each row. No shuffle: it runs alike on batches and streams."""
    return decide(build_graph(with_signals(prepare(pairs), rules)))


def verify_against(claims: DataFrame, sources: DataFrame, on: str, rules=S.DEFAULT_RULES) -> DataFrame:
    """claims (on, claim, ...) against sources (on, evidence): each source is read once, however many claims name it.

    A claim without a source is judged on empty evidence. Sources have one row for each value of on.
    """
    ready = prepare_evidence(sources).select(on, *EVIDENCE)
    both = prepare_claims(claims).join(ready, on, "left")
    empty = {"evidence_length": F.lit(0), "evidence_head": F.lit(""), "evidence_norm": F.lit("")}
    both = both.withColumns({c: F.coalesce(c, empty.get(c, F.array().cast(dict(ready.dtypes)[c]))) for c in EVIDENCE})
    return decide(build_graph(with_signals(meet(both), rules)))
