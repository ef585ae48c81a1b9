"""The web profile from verdicts to answers: tiers, the acceptance gate, answers with citations, and the graph of one claim."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web
from claimloom.functions import web_text as W

from . import signals as S
from . import web_rules as R
from .evaluate import opaque

# Fixed values.
ACCEPT_SCORE, REJECT_CONTRADICTION, MAX_UNRESOLVED = 0.72, 0.78, 0.5
MAX_CITATIONS = 12
POLICY = (
    "REJECT if any cited claim has high-confidence contradiction evidence (score >= 0.78).",
    "REVISE if a citation mismatch exists but confidence is below the reject threshold.",
    "ABSTAIN only if no sources could be retrieved or all verifiable claims are unresolved.",
    "ACCEPT when the majority of verifiable claims are supported (score >= 0.72).",
    "Unreachable sources are excluded from scoring and reported separately as coverage.",
)
JUDGED = {
    "SUPPORTED": ("SUPPORT", 0.88, 0.3, "The judge found the claim supported by the retrieved evidence."),
    "UNSUPPORTED": ("CONTRADICT", 0.84, 0.3, "The judge found a mismatch between the claim and the cited source."),
    "UNVERIFIABLE": ("INSUFFICIENT", 0.4, 0.12, "The judge could not verify the claim from the retrieved evidence."),
}

#: A model of a later tier: gets the undecided rows (with claim, windows, primary and all else), returns `id` and its own columns.
Tier = Callable[[DataFrame], DataFrame]


def judge_signal(status: Column, excerpt: Column) -> Column:
    by = lambda i: F.coalesce(*[F.when(status == k, F.lit(v[i])) for k, v in JUDGED.items()])
    return S.signal("LLM_JUDGE", by(0), by(1), by(2), by(3), excerpt)


def model_signal(status: Column, confidence: Column, excerpt: Column) -> Column:
    said = F.concat(F.lit("NLI cross-encoder classified the evidence/claim pair ("), F.round(confidence * 100).cast("int").cast("string"), F.lit("% confidence)."))
    return S.signal("NLI_MODEL", F.when(status == "SUPPORTED", "SUPPORT").otherwise("CONTRADICT"), confidence, 0.32, said, excerpt)


def attach(df: DataFrame) -> DataFrame:
    """df's status, confidence (null: the status's own), signals and extra (a nullable signal) as a result: scores are raised or cut by the status."""
    s = F.col("status")
    df = df.withColumn("confidence", F.coalesce("confidence", F.when(s == "SUPPORTED", 0.88).when(s == "UNSUPPORTED", 0.84).otherwise(0.4)))
    return df.withColumns({
        "support_score": F.when(s == "SUPPORTED", F.greatest("support_score", "confidence")).when(s == "UNSUPPORTED", F.least("support_score", F.lit(0.25))).otherwise(F.col("support_score")),
        "contradiction_score": F.when(s == "UNSUPPORTED", F.greatest("contradiction_score", "confidence")).otherwise(F.col("contradiction_score")),
        "signals": F.concat("signals", F.array_compact(F.array("extra"))),
    }).drop("extra")


def cascade(detected: DataFrame, model: Tier | None = None, judge: Tier | None = None, sure: float = 0.82) -> DataFrame:
    """detected (id, verdict, ...) with status, tier, confidence, excerpt: the rules decide, else a model that is sure, else a judge.

    model returns (id, model_status, model_confidence) and judge (id, judge_raw), of which parse_verdict reads a status. Each gets only
    the rows that nothing before it decided. Where the judge cannot tell (or there is none), some coverage without contradiction counts as support.
    """
    detected = opaque(detected)
    first = F.get("windows", F.lit(0))["text"]
    kind = dict(detected.select(S.signal("NLI_MODEL", "SUPPORT", 0.0, 0.0, "", F.lit("")).alias("s")).dtypes)["s"]
    null = F.lit(None).cast(kind)
    ruled = detected.where("verdict is not null").withColumns({"status": F.col("verdict.status"), "tier": F.lit(1), "confidence": F.col("verdict.confidence"), "excerpt": F.col("verdict.excerpt"), "corrected": F.lit(None).cast("string"), "extra": null})
    rest = detected.where("verdict is null")
    parts = [ruled]
    if model:
        told = rest.join(model(rest).select("id", "model_status", "model_confidence"), "id", "left")
        is_sure = F.coalesce(F.col("model_confidence") > sure, F.lit(False)) & F.coalesce(F.col("model_status").isin("SUPPORTED", "UNSUPPORTED"), F.lit(False))
        by_model = told.where(is_sure).withColumns({"status": F.col("model_status"), "tier": F.lit(2), "confidence": F.col("model_confidence"), "excerpt": F.lit(None).cast("string"), "corrected": F.lit(None).cast("string"), "extra": model_signal(F.col("model_status"), F.col("model_confidence"), first)})
        parts.append(by_model.drop("model_status", "model_confidence"))
        rest = told.where(~is_sure).drop("model_status", "model_confidence")
    raw = rest.join(judge(rest).select("id", "judge_raw"), "id", "left") if judge else rest.withColumn("judge_raw", F.lit(None).cast("string"))
    raw = raw.withColumn("_j", W.parse_verdict(F.coalesce("judge_raw", F.lit(""))))
    lenient = (F.col("_j.status") == "UNVERIFIABLE") & (F.col("evidence_coverage") >= 0.18) & (F.col("contradiction_score") < 0.3)
    status = F.when(lenient, "SUPPORTED").otherwise(F.col("_j.status"))
    excerpt = F.when(lenient, first).otherwise(F.col("_j.sourceExcerpt"))
    judged = raw.withColumns({"status": status, "tier": F.lit(3), "confidence": F.when(lenient, 0.58), "excerpt": excerpt, "corrected": F.when(~lenient, F.col("_j.corrected")), "extra": judge_signal(status, excerpt)})
    parts.append(judged.drop("_j", "judge_raw"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return opaque(attach(out.withColumn("confidence", F.col("confidence").cast("double"))).drop("verdict"))


def result_scores(status: Column, support: Column, contradiction: Column, confidence: Column) -> Column:
    """struct<support, contradiction, unresolved> of one result; a null score counts as the status's own."""
    of = lambda a, b, c: F.struct(a.cast("double").alias("support"), b.cast("double").alias("contradiction"), F.lit(c).cast("double").alias("unresolved"))
    zero = F.lit(0.0)
    return (
        F.when(status == "SUPPORTED", of(T.clamp01(F.greatest(F.coalesce(support, confidence, F.lit(0.88)), F.lit(0.75))), T.clamp01(F.coalesce(contradiction, zero)), 0))
        .when(status == "UNSUPPORTED", of(T.clamp01(F.coalesce(support, F.lit(0.1))), T.clamp01(F.coalesce(contradiction, confidence, F.lit(0.82))), 0))
        .when(status.isin("UNREACHABLE", "UNCITED"), of(zero, zero, 1)).otherwise(of(F.lit(0.3), zero, 1))
    )


def acceptance_gate(answers: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row for each answer: decision, label, score, risk, summary, counts by status, policy and failure modes.

    results (key, status, support_score, contradiction_score, confidence). Uncited ones do not count; unreachable ones count
    only against coverage. An answer without results abstains.
    """
    cited = results.where("status != 'UNCITED'").withColumn("_s", result_scores(F.col("status"), F.col("support_score"), F.col("contradiction_score"), F.col("confidence")))
    near = F.col("status") != "UNREACHABLE"
    names = ("SUPPORTED", "UNSUPPORTED", "UNVERIFIABLE", "UNREACHABLE")
    agg = cited.groupBy(F.col(key).alias("_of")).agg(
        *[F.count_if(F.col("status") == n).alias(n) for n in names], F.count("*").alias("total"), F.coalesce(F.avg(F.when(near, F.col("_s.support"))), F.lit(0.0)).alias("mean"),
        F.max("_s.contradiction").alias("most"), F.coalesce(F.avg(F.when(near, F.col("_s.unresolved"))), F.lit(1.0)).alias("open"),
    )
    df = answers.select(key).distinct().join(agg, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of").na.fill(0, [*names, "total"])
    good, bad, gone, total = (F.col(n) for n in ("SUPPORTED", "UNSUPPORTED", "UNREACHABLE", "total"))
    some, most = total > 0, F.col("most")
    reached = total - gone
    df = df.withColumn("score", F.when(some, T.clamp01(F.col("mean") - (most * 0.55 + F.col("open") * 0.15))).otherwise(0.0))
    df = df.withColumn("risk", F.when(some, T.clamp01(1 - F.col("score") + most * 0.3)).otherwise(1.0))
    # in order; the first that holds decides
    cases = (
        (~some, "ABSTAIN", "No citations", "No citations supplied"),
        ((bad > 0) & (most >= REJECT_CONTRADICTION), "REJECT", "Blocked", "High-confidence contradiction found"),
        (bad > 0, "REVISE", "Needs revision", "At least one citation does not support its claim"),
        (reached == 0, "ABSTAIN", "No evidence", "No sources could be retrieved"),
        ((F.col("open") > MAX_UNRESOLVED) & (good == 0), "ABSTAIN", "Insufficient evidence", "Too many claims could not be verified"),
        ((F.col("score") >= ACCEPT_SCORE) & (good >= reached * 0.7), "ACCEPT", "Accepted", None),
        ((good > 0) & (good >= reached * 0.5), "ACCEPT", "Accepted", None),
        (F.lit(True), "REVISE", "Borderline", "Support score below acceptance threshold"),
    )
    first = lambda i: F.coalesce(*[F.when(c[0], F.struct(F.lit(c[i]).cast("string").alias("x"))) for c in cases])["x"]
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    lost = F.concat(gone.cast("string"), F.lit(" source"), plural(gone))
    modes = F.array_compact(F.array(first(3), F.when(gone > 0, F.concat(lost, F.lit(" could not be retrieved")))))
    df = df.withColumns({"decision": first(1), "label": first(2), "failure_modes": modes})
    note = F.when(gone > 0, F.concat(F.lit(" ("), lost, F.lit(" unreachable)"))).otherwise("")
    pct = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int").cast("string")
    d = F.col("decision")
    summary = (
        F.when(~some, "No cited claims were available for verification.")
        .when(d == "ACCEPT", F.concat(good.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" citations verified against sources ("), pct("score"), F.lit("% confidence)"), note, F.lit(".")))
        .when(d == "REJECT", F.concat(bad.cast("string"), F.lit(" citation"), plural(bad), F.lit(" contradicted by source evidence ("), pct("risk"), F.lit("% risk)"), note, F.lit(".")))
        .when(d == "ABSTAIN", F.concat(F.lit("Could not retrieve enough evidence to verify claims"), note, F.lit(".")))
        .otherwise(F.concat(good.cast("string"), F.lit(" of "), reached.cast("string"), F.lit(" verifiable citations supported ("), pct("score"), F.lit("% score)"), note, F.lit(".")))
    )
    return df.withColumns({"summary": summary, "policy": T.words_array(POLICY)}).drop("mean", "most", "open")


def status_counts(results: DataFrame, *by: str) -> DataFrame:
    s = F.col("status")
    return results.groupBy(*by).agg(F.count_if(s == "SUPPORTED").alias("verified"), F.count_if(s == "UNSUPPORTED").alias("flagged"), F.count_if(s == "UNVERIFIABLE").alias("uncertain"), F.count_if(s == "UNREACHABLE").alias("unreachable"))


def citations(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer, citations) as one row a citation: answer_id, index, url, claim (null: not cited), atomic_claims, early status."""
    x = answers.withColumn("_claims", web.align_claims(F.col("answer"), F.col("citations")))
    x = x.select("answer_id", F.posexplode("citations").alias("index", "url"), "_claims").withColumn("claim", F.get("_claims", F.col("index"))).drop("_claims")
    status = F.when(F.col("index") >= MAX_CITATIONS, "UNVERIFIABLE").when(F.col("claim").isNull(), "UNCITED")
    atoms = web.atomic_claims(F.col("claim"))
    return x.withColumns({"status": status, "atomic_claims": F.when(F.size(atoms) > 1, atoms), "note": F.when(F.col("index") >= MAX_CITATIONS, f"Skipped (cap: {MAX_CITATIONS}).")})


def verify_answers(answers: DataFrame, pages: DataFrame, model: Tier | None = None, judge: Tier | None = None, disabled: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(results, gates) of answers (answer_id, answer, citations) with pages (url, page, search): pre-fetched texts, null where there is none.

    Claims are aligned with citations, judged by the cascade and gated by answer. A citation without a text is UNREACHABLE.
    disabled: signals that are left out of the results after the verdict.
    """
    each = citations(answers).withColumn("id", F.concat_ws(":", F.col("answer_id").cast("string"), F.col("index").cast("string")))
    texts = pages.select("url", web.assemble(F.col("url"), web.clean_page(F.col("page")), F.col("search")).alias("evidence"))
    found = each.where("status is null").drop("status").join(texts, "url", "left")
    judged = cascade(R.run(found.where("evidence is not null")), model, judge)
    judged = judged.withColumn("signals", F.filter("signals", lambda s: ~s["name"].isin(*disabled))) if disabled else judged
    columns = ("answer_id", "index", "url", "claim", "atomic_claims", "status", "tier", "confidence", "support_score", "contradiction_score", "evidence_coverage", "excerpt", "corrected", "signals")
    judged = judged.select(*columns)
    early = each.where("status is not null").withColumn("excerpt", F.col("note")).unionByName(found.where("evidence is null").withColumn("status", F.lit("UNREACHABLE")), allowMissingColumns=True)
    results = judged.unionByName(early.select(*[c for c in columns if c in early.columns]), allowMissingColumns=True)
    return results, acceptance_gate(answers, results, "answer_id")


def claim_graph(pairs: DataFrame) -> DataFrame:
    """pairs (id, claim, evidence, url) with nodes, edges and gate (decision, score, risk, summary) of the web profile.

    Edges of one source, target and kind, and nodes of one id, are kept once, the first. The gate is that of the one result.
    """
    L = F.lit
    df = opaque(R.run(pairs))
    v = F.col("verdict")
    one = df.select("id", F.coalesce(v["status"], L("UNVERIFIABLE")).alias("status"), "support_score", "contradiction_score", v["confidence"].alias("confidence"))
    gate = acceptance_gate(one.select("id"), one, "id").select("id", F.struct("decision", "score", "risk", "summary").alias("gate"))
    df = df.join(gate, "id").withColumn("texts", F.array_join(F.transform("windows", lambda w: w["text"]), " "))
    df = df.withColumns({"text_set": W.set_of(W.normalize(F.col("texts"))), "text_numbers": W.graph_numbers(F.col("texts"))})
    edge = lambda s, t, k, w, label: F.struct(s.alias("source"), t.alias("target"), k.alias("kind"), w.cast("double").alias("weight"), label.alias("label"))
    node = lambda i, k, label, score=L(None), detail=L(None): F.struct(i.alias("id"), L(k).alias("kind"), label.alias("label"), score.cast("double").alias("score"), detail.cast("string").alias("detail"))
    claim, source, gate_, to = L("claim:0"), L("source:0"), L("gate:0"), F.when(F.size("windows") > 0, "evidence:0").otherwise("source:0")
    ids = lambda kind, xs, found: F.transform(xs, lambda x, i: F.struct(x.alias("x"), T.node_id(kind, x, i, 28).alias("id"), found(x).alias("found")))
    df = df.withColumns({
        "_e": ids("entity", W.graph_entities(F.col("claim")), lambda x: F.array_contains("text_set", F.lower(x)) | F.contains(F.col("texts"), x)),
        "_q": ids("quantity", W.graph_numbers(F.col("claim")), lambda x: F.array_contains("text_numbers", x)),
        "_r": ids("relation", W.graph_relations(F.col("claim")), lambda x: T.let(W.tokenize(x), lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, lambda t: F.array_contains("claim_set", t) | F.array_contains("text_set", t))) / F.size(ts)).otherwise(0.0))),
        "_s": F.filter(F.transform("signals", lambda s, i: F.struct(s.alias("s"), F.concat(L("signal:"), F.lower(s["name"]), L(":"), i.cast("string")).alias("id"))), lambda x: x["s"]["verdict"] != "NEUTRAL"),
    })
    df = opaque(df)
    ev = lambda i: F.concat(L("evidence:"), i.cast("string"))
    kind_of = lambda s: F.when(s["verdict"] == "CONTRADICT", "contradicts").when(s["verdict"] == "SUPPORT", "supports").otherwise("attenuates")
    pct = lambda c: F.concat(F.floor(c * 100 + 0.5).cast("int").cast("string"), L("% coverage"))
    edges = F.flatten(F.array(
        F.array(edge(claim, source, L("cites"), L(1.0), L("cites")), edge(claim, gate_, L("routes"), F.col("gate.score"), L("gate input"))),
        F.flatten(F.transform("windows", lambda w, i: F.array(edge(source, ev(i), L("contains"), w["overlap"], pct(w["coverage"])), edge(ev(i), claim, F.when(w["coverage"] >= 0.62, "grounds").otherwise("routes"), w["coverage"], L("grounds claim"))))),
        F.flatten(F.transform("_e", lambda x: F.array(edge(claim, x["id"], L("mentions"), L(0.9), L("mentions")), edge(x["id"], to, F.when(x["found"], "grounds").otherwise("attenuates"), F.when(x["found"], 0.9).otherwise(0.3), F.when(x["found"], "found in evidence").otherwise("missing from evidence"))))),
        F.flatten(F.transform("_q", lambda x: F.array(edge(claim, x["id"], L("mentions"), L(0.9), L("uses number")), edge(x["id"], to, F.when(x["found"], "grounds").otherwise("contradicts"), F.when(x["found"], 0.9).otherwise(0.75), F.when(x["found"], "number matched").otherwise("number missing"))))),
        F.flatten(F.transform("_r", lambda x: F.array(edge(claim, x["id"], L("mentions"), L(0.8), L("relation")), edge(x["id"], to, F.when(x["found"] > 0.7, "grounds").otherwise("routes"), x["found"], L("relation evidence"))))),
        F.flatten(F.transform("_s", lambda x: F.array(edge(x["id"], claim, kind_of(x["s"]), x["s"]["score"] * x["s"]["weight"], F.lower(x["s"]["verdict"])), edge(x["id"], gate_, F.when(x["s"]["verdict"] == "CONTRADICT", "contradicts").otherwise("routes"), x["s"]["score"], L("gate signal"))))),
    ))
    nodes = F.flatten(F.array(
        F.array(node(claim, "claim", W.clip(F.col("claim"), 80), F.col("gate.score")), node(source, "source", F.coalesce(W.clip(F.col("url"), 60), L("Retrieved evidence"))), node(gate_, "gate", F.col("gate.decision"), F.col("gate.score"), F.col("gate.summary"))),
        F.transform("windows", lambda w, i: node(ev(i), "evidence", F.concat(L("Evidence window "), (i + 1).cast("string")), w["coverage"], w["text"])),
        F.transform("_e", lambda x: node(x["id"], "entity", x["x"], F.when(x["found"], 1.0).otherwise(0.25))), F.transform("_q", lambda x: node(x["id"], "quantity", x["x"], F.when(x["found"], 1.0).otherwise(0.2))),
        F.transform("_r", lambda x: node(x["id"], "relation", x["x"], x["found"])), F.transform("_s", lambda x: node(x["id"], "signal", x["s"]["label"], x["s"]["score"], x["s"]["rationale"])),
    ))
    once = lambda xs, key: T.let(xs, lambda all_: T.let(F.transform(all_, key), lambda ks: F.filter(all_, lambda x, i: F.array_position(ks, key(x)) == i + 1)))
    df = df.withColumns({"nodes": once(nodes, lambda x: x["id"]), "edges": once(edges, lambda e: F.concat_ws("\t", e["source"], e["target"], e["kind"]))})
    return df.drop("_e", "_q", "_r", "_s", "texts", "text_set", "text_numbers")


def comparison(counts: DataFrame) -> DataFrame:
    """counts (unsupported, rejected, false_accepts) with what a gate changes against none: both false accept rates, what is intercepted and left open."""
    u, r, f = F.col("unsupported"), F.col("rejected"), F.col("false_accepts")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.withColumns({
        "abstained": u - r - f, "baseline_false_accept_rate": F.when(u > 0, 1.0).otherwise(0.0), "far_of_decided": share(f, r + f), "far_of_all": share(f, u), "false_accept_reduction": F.when(u > 0, 1 - f / u).otherwise(0.0),
        "intercepted_share": share(r, u), "intercepted_or_routed_share": share(u - f, u),
    })
