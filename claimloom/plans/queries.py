"""The engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web
from claimloom.operators import evaluate as V
from claimloom.operators import evidence, gate, graph, signals, vectors
from claimloom.sources import io

from . import sql as Q


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, pos, cid, claim, of): every sentence of every document, the first against its own document, the others against the next one."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "claim"))
    return docs.select("doc_id", "source", "pos", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("cid"), "claim", (F.col("doc_id") + (F.col("pos") > 0).cast("long")).alias("of"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("of"), F.col("text").alias("evidence"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """claims with their evidence as (id, claim, evidence); null where there is no next document."""
    return claims(spark, d).join(sources(spark, d), "of", "left").select(F.col("cid").alias("id"), "claim", "evidence")


def verified(spark, d, rules=signals.DEFAULT_RULES):
    return graph.verify_against(claims(spark, d), sources(spark, d), "of", rules)


def r6(c):
    return F.round(c, 6)


def verify(spark, d):
    out = verified(spark, d)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "decision", "status", r6("support_score").alias("support"), r6("contradiction_score").alias("contradiction"), r6("evidence_coverage").alias("coverage"), r6("risk").alias("risk"), r6("confidence").alias("confidence"), F.sha2("excerpt", 256).alias("excerpt"))


def graph_edges(spark, d):
    """Edges of all graphs by kind and label."""
    e = verified(spark, d).select(F.explode_outer("edges").alias("e"))  # outer: else a filter on the array is inferred, pushed below and computes all of it again
    return e.groupBy(F.col("e.kind").alias("kind"), F.col("e.label").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("e.weight"), 3).alias("weight"))


def graph_nodes(spark, d):
    """Nodes of all graphs by kind, with a digest of their ids, labels and details."""
    n = verified(spark, d).select("cid", F.explode_outer("nodes").alias("n"))
    digest = F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "cid", "n.id", "n.label", "n.detail")), 1, 8), 16, 10).cast("long"))
    return n.groupBy(F.col("n.kind").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("n.score"), 3).alias("score"), digest.alias("digest"))


def tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def sentences(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


def entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.extract_entities(F.col("text")), "|").alias("entities"))


def numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.extract_numbers(F.col("text")), "|").alias("numbers"))


def windows_top3(spark, d):
    ready = graph.prepare_evidence(sources(spark, d)).select("of", "sentences", "sentence_sets")
    c = claims(spark, d).withColumn("ct", T.token_set(F.col("claim"))).join(ready, "of")
    w = c.select("cid", F.posexplode_outer(evidence.best_windows(F.col("ct"), F.col("sentences"), F.col("sentence_sets"))).alias("rank", "w")).where("w is not null")
    return w.select("cid", (F.col("rank") + 1).cast("long").alias("rank"), F.col("w.position").cast("long").alias("position"), r6("w.coverage").alias("coverage"), r6("w.overlap").alias("overlap"))


def windows_long(spark, d):
    w = evidence.windows_long_against(claims(spark, d).withColumnRenamed("cid", "id"), sources(spark, d), "of")
    return w.select(F.col("id").alias("cid"), F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"), r6("coverage").alias("coverage"), r6("overlap").alias("overlap"))


def gate_by_source(spark, d):
    """A gate for each source of documents, also for a null one."""
    return gate.gate(table(spark, d, "documents"), verified(spark, d), "source")


def labelled_runs(spark, d):
    """labels as runs: quality is the label, not toxic the prediction; odd ids are undecided."""
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred"), (F.col("doc_id") % 2 == 0).alias("decided"))


def _rounded(df, *plain):
    return df.select(*[c if c in plain else (r6(F.col(c)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


def core_metrics(spark, d):
    return _rounded(V.core_metrics(labelled_runs(spark, d)))


def abstention_views(spark, d):
    return _rounded(V.abstention_views(labelled_runs(spark, d)))


def scored(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("score"))


def threshold_sweep(spark, d):
    return _rounded(V.threshold_sweep(scored(spark, d), [i / 20 for i in range(21)]))


def threshold_best(spark, d):
    return _rounded(V.best_threshold(V.threshold_sweep(scored(spark, d), [i / 20 for i in range(21)])))


def calibration(spark, d):
    return _rounded(V.calibration_error(scored(spark, d).select(F.col("score").alias("confidence"), (F.col("label") == 1).alias("correct"))))


def expected(spark, d, rules=signals.DEFAULT_RULES):
    """A claim is expected to be supported where its source has the very sentence."""
    return verified(spark, d, rules).withColumn("expected", F.when(F.array_contains("sentences", F.col("claim")), "SUPPORTED").otherwise("UNSUPPORTED"))


def benchmark_summary(spark, d):
    return _rounded(V.benchmark_summary(expected(spark, d)))


def per_signal(spark, d):
    return V.per_signal(expected(spark, d))


def eight_rules(spark, d):
    s = verified(spark, d, signals.EIGHT_RULES).select(F.explode_outer("signals").alias("s")).where("s is not null")
    return s.groupBy(F.col("s.name").alias("name"), F.col("s.verdict").alias("verdict")).agg(F.count("*").alias("n"))


def breakdown(spark, d):
    """Documents and characters by source and language, with totals; null sources and languages are groups as any other."""
    x = table(spark, d, "documents").rollup("source", "lang").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return x.select("source", "lang", "level", "n", "chars")


def wilson_by_source(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = V.wilson(F.col("k"), F.col("n"))
    return x.select("source", "k", "n", r6(lo).alias("low"), r6(hi).alias("high"))


def tier_compose(spark, d):
    runs = labelled_runs(spark, d)
    out = V.compose_tiers(runs, runs.select("id", (1 - F.col("pred")).alias("pred")))
    return out.groupBy("tier").agg(F.count("*").alias("n"), F.sum("pred").alias("accepted"))


def resume_anti(spark, d):
    return V.resume(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def sampling(spark, d):
    return io.sample_documents(table(spark, d, "documents"), 60, "seed-42").select("doc_id", F.length("text").cast("long").alias("n"))


def url_predicates(spark, d):
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1))
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.regexp_like(host, F.lit(r"(\.edu|\.ac\.|arxiv|doi\.org)")).alias("academic"), F.regexp_like(F.col("url"), F.lit(r"utm_")).alias("tracked"))


def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(web.clean_page(F.col("html")), 256).alias("digest"))


def cosine_argmax(spark, d):
    """For each vector, the one of the label before that is nearest, of all of them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), F.col("label").alias("case"))
    source = e.select((F.col("case") + 1).cast(dict(e.dtypes)["case"]).alias("case"), "pos", "vec")
    return _rounded(vectors.best_in_blocks(e, source).select(F.col("pos").alias("vec_id"), "best", "sim"))


def retention(spark, d):
    """Answers of conversations against the turn before: claims of each assistant turn, gated by conversation."""
    c = table(spark, d, "conversations")
    of = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    ask = c.select(of(F.col("turn")).alias("of"), F.col("text").alias("evidence"))
    say = c.where("role = 'assistant'").select("conv_id", of(F.col("turn") - 1).alias("of"), F.explode(T.split_sentences(F.col("text"))).alias("claim"))
    return graph.verify_against(say, ask, "of").groupBy("conv_id").agg(gate.aggregate(F.col("decision")).alias("gate"), F.count("*").alias("claims"))


QUERIES = {f.__name__: f for f in (verify, graph_edges, graph_nodes, tokens, sentences, entities, numbers, windows_top3, windows_long, gate_by_source, core_metrics, abstention_views, threshold_sweep, threshold_best, calibration, benchmark_summary, per_signal, eight_rules, breakdown, wilson_by_source, tier_compose, resume_anti, sampling, url_predicates, page_text, cosine_argmax, retention)}

_GRADE = """count(*) filter (y = 0 and p = 0) tp, count(*) filter (y = 1 and p = 0) fp, count(*) filter (y = 0 and p = 1) fn, count(*) filter (y = 1 and p = 1) tn"""
_RATES = """coalesce(tp / nullif(tp + fp, 0), 0) "precision", coalesce(tp / nullif(tp + fn, 0), 0) recall, coalesce(fn / nullif(tp + fn, 0), 0) far, coalesce(fp / nullif(fp + tn, 0), 0) frr,
  coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 balanced_accuracy"""
_FINAL = """tp, fp, fn, tn, round("precision", 6) "precision", round(recall, 6) recall, round(far, 6) far, round(frr, 6) frr, round(accuracy, 6) accuracy, round(balanced_accuracy, 6) balanced_accuracy,
  round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), 6) f1"""
_RUNS = "runs as (select doc_id id, quality y, 1 - toxic p, doc_id % 2 = 0 decided from labels)"
_SCORED = "scored as (select quality y, ((doc_id * 37) % 101) / 100.0::double s from labels)"
_SWEEP = f"{_SCORED}, sweep as (select t / 20.0::double threshold, {_GRADE} from (select y, t, (s >= t / 20.0::double)::int p from scored, range(0, 21) r(t)) group by 1), rates as (select *, {_RATES} from sweep)"
_EXPECTED = "gold as (select *, list_contains(ess, claim) gold from verdict)"
_DOCS = "from documents"

ORACLE = {
    "verify": f"with {Q.PAIRS}, {Q.VERIFIED} select doc_id, pos, decision, case decision when 'ACCEPT' then 'SUPPORTED' when 'REJECT' then 'UNSUPPORTED' else 'UNVERIFIABLE' end status, round(support, 6) support, round(contradiction, 6) contradiction, round(coverage, 6) coverage, round(risk, 6) risk, round(greatest(support, case when decision = 'ACCEPT' then 1 - risk else risk end), 6) confidence, sha256(coalesce(texts[1], evidence[:240])) excerpt from verdict",
    "graph_edges": f"with {Q.PAIRS}, {Q.VERIFIED}, {Q.EDGES} select kind, label, count(*) n, round(sum(weight), 3) weight from edges group by 1, 2",
    "graph_nodes": f"with {Q.PAIRS}, {Q.VERIFIED}, {Q.EDGES} select kind, count(*) n, round(sum(score), 3) score, sum(('0x' || md5(cid || '|' || id || '|' || label || '|' || detail)[:8])::bigint)::bigint digest from node group by 1",
    "tokens": f"select doc_id, len(t) n, sha256(array_to_string(t, ' ')) digest from (select doc_id, {Q.tokens('text')} t {_DOCS})",
    "sentences": f"select doc_id, len(s) n, sha256(array_to_string(s, '|')) digest from (select doc_id, {Q.sentences('text')} s {_DOCS})",
    "entities": f"select doc_id, array_to_string({Q.entities('text')}, '|') entities {_DOCS}",
    "numbers": f"select doc_id, array_to_string({Q.numbers('text')}, '|') numbers {_DOCS}",
    "windows_top3": f"with {Q.PAIRS}, {Q.VERIFIED} select cid, nth rank, position, round(cov, 6) coverage, round(overlap, 6) overlap from ranked",
    "windows_long": f"with {Q.PAIRS}, {Q.VERIFIED} select cid, nth rank, position, round(cov, 6) coverage, round(overlap, 6) overlap from ranked",
    "gate_by_source": f"with {Q.PAIRS}, {Q.VERIFIED}, {Q.GATE} select d.source, coalesce(gate, 'ABSTAIN') gate from (select distinct source from documents) d left join gate on grp is not distinct from d.source",
    "eight_rules": f"with {Q.PAIRS}, {Q.VERIFIED}, {Q.EIGHT} select name, verdict, count(*) n from fired group by 1, 2",
    "retention": f"with {Q.TURNS}, {Q.VERIFIED}, {Q.GATE} select grp conv_id, gate, claims from gate",
    "core_metrics": f"with {_RUNS}, sums as (select {_GRADE} from runs), rates as (select *, {_RATES} from sums) select {_FINAL} from rates",
    "abstention_views": f"with {_RUNS}, v as (select y, decided, case when decided then p when name = 'accept' then 1 when name = 'escalate' then 0 end p, name as \"view\" from runs, (values ('decided'), ('accept'), ('escalate')) n(name)), sums as (select \"view\", {_GRADE}, round(avg(decided::int), 6) coverage, count(*) n_total, count(*) filter (decided) n_decided from v group by 1), rates as (select *, {_RATES} from sums) select \"view\", {_FINAL}, coverage, n_total, n_decided from rates",
    "threshold_sweep": f"with {_SWEEP} select threshold, {_FINAL} from rates",
    "threshold_best": f"with {_SWEEP} select threshold, round(balanced_accuracy, 6) balanced_accuracy from rates order by balanced_accuracy desc, threshold limit 1",
    "calibration": f"with {_SCORED}, b as (select i, avg(s) c, avg((y = 1)::int) a, count(*) n from (select *, case when s < 1 then (select max(i) from range(0, 10) r(i) where s >= i / 10.0::double) end i from scored) group by 1) select round(coalesce(sum(case when i is not null then abs(c - a) * n end) / sum(n), 0), 6) ece, sum(n)::bigint scored from b",
    "benchmark_summary": f"""with {Q.PAIRS}, {Q.VERIFIED}, {_EXPECTED}, s as (select count(*) total, {", ".join(f"count(*) filter ({'' if side == 'supported' else 'not '}gold and decision {op}) {side}_{name}" for side in ("supported", "unsupported") for name, op in (("accepted", "= 'ACCEPT'"), ("rejected", "= 'REJECT'"), ("routed", "not in ('ACCEPT', 'REJECT')")))}, count(*) filter (gold) supported, count(*) filter (not gold) unsupported from gold)
select *, round(unsupported_accepted / greatest(unsupported, 1), 6) false_accept_rate, round(supported_rejected / greatest(supported, 1), 6) false_reject_rate from s""",
    "per_signal": f"with {Q.PAIRS}, {Q.VERIFIED}, {_EXPECTED}, fired as (select 'LEXICAL_OVERLAP' name, gold from gold where lex >= 0.6 union all select 'EVIDENCE_COVERAGE', gold from gold where cover >= 0.65) select name, count(*) fires, count(*) filter (gold) correct, count(*) filter (not gold) incorrect from fired group by 1",
    "breakdown": "select source, lang, grouping(source, lang) level, count(*) n, sum(n_chars)::bigint chars from documents group by rollup (source, lang)",
    "wilson_by_source": "with x as (select source, sum(quality)::bigint k, count(*) n from documents join labels using (doc_id) group by 1), p as (select *, k / n p, 1.96 z from x) select source, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) high from p",
    "tier_compose": f"with {_RUNS} select case when decided then 'tier1' else 'tier2' end tier, count(*) n, sum(case when decided then p else 1 - p end)::bigint accepted from runs group by 1",
    "resume_anti": "select doc_id id from documents where doc_id not in (select doc_id from labels where doc_id is not null)",
    "sampling": "select doc_id, length(text) n from (select text, min(doc_id) doc_id from documents where length(text) > 500 and length(text) < 3000 group by 1) order by sha256('seed-42' || text), doc_id limit 60",
    "url_predicates": r"select page_id, host, regexp_matches(host, '(\.edu|\.ac\.|arxiv|doi\.org)') academic, regexp_matches(url, 'utm_') tracked from (select *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) host from pages)",
    "page_text": r"select page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '\[([^\]]*)\]\(https?://[^)]+\)', '\1', 'g'), 'https?://\S+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) digest from pages",
    "cosine_argmax": "with s as (select label + 1 l, vec_id v, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings), p as (select a.vec_id, s.v, list_inner_product(a.e, s.e) / (a.n * s.n) c from (select vec_id, label, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings) a join s on a.label = l) select vec_id, v best, round(c, 6) sim from p qualify row_number() over (partition by vec_id order by c desc, v) = 1",
}
