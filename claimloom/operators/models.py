"""Seams for models: a loader runs once a worker, a scorer gets batches of rows. What surrounds the models is native; no model comes with the package.

A scorer is a function of a pandas frame that returns one frame of new columns, row by row. Loaders make scorers, so that weights
are read where they are used. Prompts are made by columns, so a text model is a scorer with a `prompt` column that returns `text`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web_text as W

from . import evidence as E
from . import experiments as X
from . import graph
from . import signals as S
from . import vectors

Loader = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]

REWRITE = (
    "Rewrite the claim below so it states only what the document supports. Keep it to one sentence. If the document says something different from the claim, state what the document actually says. "
    "Do not add explanations.\n\nDocument:\n", "\n\nClaim: ", "\n\nRewrite:",
)
DECOMPOSE = ("Split the claim below into its individual facts. Write one short, self-contained sentence per fact. Output only the numbered facts, nothing else.\n\nClaim: ", "\n\nFacts:")


def predict(df: DataFrame, load: Loader, schema: str, inputs: tuple[str, ...], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep and the scorer's columns (schema) for each row. Only inputs and keep reach Python, in Arrow batches."""
    kinds = dict(df.dtypes)

    def run(batches):
        score = load()
        for t in batches:
            out = score(t[list(inputs)]).reset_index(drop=True)
            if len(out) != len(t):
                raise ValueError(f"a scorer returned {len(out)} rows for {len(t)}")
            yield pd.concat([t[list(keep)].reset_index(drop=True), out], axis=1)

    narrow = df.select(*dict.fromkeys([*keep, *inputs]))
    return narrow.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), schema]))


def pair_scores(pairs: DataFrame, load: Loader, chunk: Callable[[Column], Column] = X.token_chunks) -> DataFrame:
    """(id, entailment, contradiction): the most of each over overlapping chunks of the evidence. The scorer gets premise and hypothesis."""
    chunks = pairs.select("id", F.col("claim").alias("hypothesis"), F.explode(chunk(F.col("evidence"))).alias("premise"))
    scored = predict(chunks, load, "entailment double, contradiction double", ("premise", "hypothesis"))
    return scored.groupBy("id").agg(F.max("entailment").alias("entailment"), F.max("contradiction").alias("contradiction"))


def thresholded(scores: DataFrame, score: str, threshold: float) -> DataFrame:
    """A scorer's rows as decided run rows: pred 1 from the threshold on."""
    return scores.withColumns({"score": F.col(score), "pred": (F.col(score) >= threshold).cast("int"), "decided": F.lit(True)})


def tiered(runs: DataFrame, second: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """runs with their undecided rows scored by second (id, pred, score), which never sees the decided ones; tier tells which decided."""
    first = runs.where("decided").withColumn("tier", F.lit("signals"))
    rest = runs.where("not decided")
    told = rest.drop("pred", "score", "decided").join(second(rest).select("id", "pred", "score"), "id", "left")
    told = told.withColumns({"decided": F.col("pred").isNotNull(), "tier": F.lit(name)})
    return first.unionByName(told.select(*[c for c in first.columns]))


def numeric_match(claim: Column, text: Column) -> Column:
    """The share of a claim's numbers that a text has; 1 for none."""
    return T.let(T.extract_numbers(claim), lambda ns: F.when(F.size(ns) > 0, F.size(F.filter(ns, lambda n: F.contains(T.normalize_for_match(text), n))) / F.size(ns)).otherwise(1.0))


def alignment(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Token-embedding alignment: (id, score, verdict) of tokens (id, side, pos, token, vec, content) and pairs (id, claim, evidence).

    content tokens of the claim that are no numbers are each aligned with their nearest source token; without any the verdict is neutral.
    """
    mine = tokens.where("side = 'claim' and content")
    claim = mine.where(~F.regexp_like("token", F.lit(r"^\P{L}*[0-9][0-9.,%]*$"))).select(F.col("id").alias("case"), "pos", "vec")
    source = tokens.where("side = 'source'").select(F.col("id").alias("case"), "pos", "vec")
    numbers = pairs.select(F.col("id").alias("case"), numeric_match(F.col("claim"), F.col("evidence")).alias("n"))
    scored = vectors.alignment_score(vectors.best_in_blocks(claim, source), numbers).withColumnRenamed("case", "id")
    some = mine.select("id").distinct().withColumn("some", F.lit(True))
    out = pairs.select("id").join(scored, "id", "left").join(some, "id", "left").join(numbers.withColumnRenamed("case", "id"), "id")
    # numbers alone: half their match stands for the mean, .5 for the least
    alone = 0.40 * 0.5 * F.col("n") + 0.20 * 0.5 + 0.25 * F.col("n") + 0.15
    score = F.coalesce("score", F.when(F.col("some"), alone).otherwise(0.5))
    told = F.when((alone >= 0.65) & (F.col("n") >= 0.5), "SUPPORT").when((alone < 0.45) | (F.col("n") < 0.3), "CONTRADICT").otherwise("NEUTRAL")
    return out.select("id", score.alias("score"), F.coalesce("verdict", F.when(F.col("some"), told), F.lit("NEUTRAL")).alias("verdict"))


def alignment_signal(score: Column, verdict: Column, evidence: Column) -> Column:
    """The alignment as a rule's signal; null where it is neutral."""
    said = F.when(verdict == "SUPPORT", "Token embeddings of the claim align with the source.").otherwise("Token embeddings of the claim do not align with the source.")
    return F.when(verdict != "NEUTRAL", S.signal("EMBEDDING_ALIGNMENT", verdict, score, 0.35, said, evidence))


def roundtrip(pairs: DataFrame, rewrite: Loader, entail: Loader) -> DataFrame:
    """(id, rewrite, entailment, contradiction, numeric_match, score): whether a claim survives a rewrite on its document (id, claim, evidence)."""
    prompt = F.concat(F.lit(REWRITE[0]), F.substring("evidence", 1, 6000), F.lit(REWRITE[1]), F.col("claim"), F.lit(REWRITE[2]))
    written = predict(pairs.select("id", "claim", prompt.alias("prompt")), rewrite, "text string", ("prompt",), ("id", "claim")).withColumn("rewrite", F.coalesce(W.clean_rewrite(F.col("text")), F.lit("")))
    probs = predict(written.where("rewrite != ''").select("id", F.col("rewrite").alias("premise"), F.col("claim").alias("hypothesis")), entail, "entailment double, contradiction double", ("premise", "hypothesis"))
    x = written.join(probs, "id", "left").withColumn("numeric_match", F.when(F.col("rewrite") != "", numeric_match(F.col("claim"), F.col("rewrite"))).otherwise(1.0))
    x = x.withColumns({"entailment": F.coalesce("entailment", F.lit(0.5)), "contradiction": F.coalesce("contradiction", F.lit(0.0))})
    score = F.col("entailment") * (0.5 + 0.5 * F.col("numeric_match")) * F.when(F.col("contradiction") > 0.5, 0.25).otherwise(1.0)
    return x.select("id", "rewrite", "entailment", "contradiction", "numeric_match", F.when(F.col("rewrite") != "", score).otherwise(0.5).alias("score"))


def decomposed(pairs: DataFrame, split: Loader, entail: Loader) -> DataFrame:
    """(id, n_atoms, min_entailment, mean_entailment, max_contradiction, score): each of a claim's facts against its best window, the weakest weighing most."""
    prompt = F.concat(F.lit(DECOMPOSE[0]), F.col("claim"), F.lit(DECOMPOSE[1]))
    facts = predict(pairs.select("id", "claim", prompt.alias("prompt")), split, "text string", ("prompt",), ("id", "claim"))
    atoms = facts.select("id", F.posexplode(W.listed_facts(F.coalesce("text", F.lit("")), F.col("claim"))).alias("n", "atom"))
    ready = graph.prepare_evidence(pairs.select("id", "evidence")).select("id", "evidence_head", "sentences", "sentence_sets")
    x = atoms.join(ready, "id").withColumn("w", E.best_windows(T.token_set(F.col("atom")), F.col("sentences"), F.col("sentence_sets"), 1))
    x = x.select("id", "n", F.coalesce(F.get("w", F.lit(0))["text"], F.substring("evidence_head", 1, 700)).alias("premise"), F.col("atom").alias("hypothesis"))
    probs = predict(x, entail, "entailment double, contradiction double", ("premise", "hypothesis"))
    out = probs.groupBy("id").agg(F.count("*").alias("n_atoms"), F.min("entailment").alias("min_entailment"), F.avg("entailment").alias("mean_entailment"), F.max("contradiction").alias("max_contradiction"))
    return out.withColumn("score", (0.6 * F.col("min_entailment") + 0.4 * F.col("mean_entailment")) * (1 - 0.5 * F.col("max_contradiction")))


def answer_prompt(context: Column, question: Column, feedback: Column | None = None) -> Column:
    base = F.concat(F.lit("Answer the question using ONLY the information in the context. Do not add facts that are not in the context.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n"))
    if feedback is not None:
        base = F.concat(base, F.lit("\nYour previous answer contained claims not supported by the context:\n"), feedback, F.lit("\nRewrite the answer using only supported information.\n"))
    return F.concat(base, F.lit("\nAnswer:"))


def _answer_claims(answer: Column) -> Column:
    return T.let(T.strip(F.coalesce(answer, F.lit(""))), lambda a: T.let(T.split_sentences(a), lambda ss: F.when(F.size(ss) > 0, ss).when(a != "", F.array(a)).otherwise(F.slice(ss, 1, 0))))


def verify_generation(answers: DataFrame) -> DataFrame:
    """answers (id, context, answer) with verdicts: array<struct<n, claim, status, confidence, reason>>, in order; empty for an empty answer."""
    claims = answers.select("id", F.posexplode(_answer_claims(F.col("answer"))).alias("n", "claim"))
    told = graph.verify_against(claims, answers.select("id", F.col("context").alias("evidence")), "id")
    each = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "claim", "status", "confidence", "reason"))).alias("verdicts"))  # an answer's own claims
    return answers.join(each, "id", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast(dict(each.dtypes)["verdicts"])))


def generate_verified(questions: DataFrame, write: Loader, regenerations: int = 1) -> DataFrame:
    """questions (id, context, question) answered, verified, and written again with the failing claims named while any fail; what still fails is left out.

    Only answers with failing claims go to the model again. Returns (id, raw_answer, final_answer, verdicts, regenerations, n_claims,
    n_supported, n_unsupported, n_unverifiable, blocked).
    """
    failing = F.filter("verdicts", lambda v: v["status"] == "UNSUPPORTED")
    first = predict(questions.select("id", answer_prompt(F.col("context"), F.col("question")).alias("prompt")), write, "answer string", ("prompt",))
    state = verify_generation(questions.join(first, "id")).withColumns({"raw_answer": F.col("answer"), "regenerations": F.lit(0)})
    for _ in range(regenerations):
        state = state.withColumn("_bad", failing)
        open_ = state.where(F.size("_bad") > 0)
        feedback = F.array_join(F.transform(F.slice("_bad", 1, 5), lambda v: F.concat(F.lit("- "), v["claim"], F.lit(" ("), v["reason"], F.lit(")"))), "\n")
        again = predict(open_.select("id", answer_prompt(F.col("context"), F.col("question"), feedback).alias("prompt")), write, "answer string", ("prompt",))
        redone = verify_generation(open_.drop("answer", "verdicts", "_bad").join(again, "id")).withColumn("regenerations", F.col("regenerations") + 1)
        state = state.where(F.size("_bad") == 0).drop("_bad").unionByName(redone)
    count = lambda s: F.size(F.filter("verdicts", lambda v: v["status"] == s))
    final = F.array_join(F.transform(F.filter("verdicts", lambda v: v["status"] != "UNSUPPORTED"), lambda v: v["claim"]), " ")
    out = state.withColumn("final_answer", T.strip(final))
    return out.select(
        "id", "raw_answer", "final_answer", "verdicts", "regenerations", F.size("verdicts").alias("n_claims"), count("SUPPORTED").alias("n_supported"), count("UNSUPPORTED").alias("n_unsupported"),
        count("UNVERIFIABLE").alias("n_unverifiable"), (F.col("final_answer") == "").alias("blocked"),
    )


def repaired(prompts: DataFrame, write: Loader) -> DataFrame:
    """prompts (id, prompt, evidence) drafted, gated as one claim, and written again where the gate does not accept; (id, text, decision, risk, revised).

    The second writer gets the risk with the prompt, so that it can bias its scores (see risk_bias).
    """
    draft = predict(prompts.withColumn("risk", F.lit(0.0)), write, "claim string", ("prompt", "risk"), ("id", "prompt", "evidence"))
    gated = graph.verify(draft)
    fine = gated.where("decision = 'ACCEPT'").select("id", F.col("claim").alias("text"), "decision", "risk", F.lit(False).alias("revised"))
    parts = ("You are generating a cited answer, but a verification graph flagged the draft.\n\nOriginal prompt:\n", F.col("prompt"), "\n\nDraft:\n", F.col("claim"), "\n\nVerification decision:\n", F.col("decision"), " - ", F.col("reason"),
             "\n\nUse only the evidence below. If the evidence does not support the answer, say that the cited source does not support the claim.\n\nEvidence:\n", F.col("evidence"), "\n\nRevised answer:")
    prompt = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    bad = gated.where("decision != 'ACCEPT'").select("id", prompt.alias("prompt"), "evidence", "risk")
    again = graph.verify(predict(bad, write, "claim string", ("prompt", "risk"), ("id", "evidence")))
    return fine.unionByName(again.select("id", F.col("claim").alias("text"), "decision", "risk", F.lit(True).alias("revised")))


def risk_bias(scores: Column, risk: Column, abstain: list[int], revise: list[int], threshold: float = 0.62, boost: float = 2.0) -> Column:
    """A decoder's scores (array<double>) biased by risk: from the threshold on, abstaining ids gain boost times risk (1 at most), revising ids .6 of that."""
    gain = lambda i: F.lit(0.0) + sum((F.when(i == k, w).otherwise(0.0) for ids, w in ((abstain, 1.0), (revise, 0.6)) for k in ids), F.lit(0.0))
    scale = boost * T.clamp01(risk)
    return F.when(risk >= threshold, F.transform(scores, lambda s, i: s + gain(i) * scale)).otherwise(scores)
