"""Queries of the web profile, experiments, tensors and tables over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import web
from claimloom.functions import web_text as W
from claimloom.operators import evaluate as V
from claimloom.operators import experiments as X
from claimloom.operators import graph, signals, tensors, vectors, web_gate
from claimloom.operators import web_rules as R
from claimloom.sources import io, tables

from . import queries as base
from . import sql as Q

r6, table = base.r6, base.table


def digest(items) -> F.Column:
    return F.sha2(F.array_join(items, "|"), 256).alias("digest")


# Web profile: text


def web_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", W.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), digest("t"))


def web_entities(spark, d):
    t = table(spark, d, "documents").select("doc_id", W.extract_entities(F.col("text")).alias("e"), W.graph_entities(F.col("text")).alias("g"), W.graph_numbers(F.col("text")).alias("q"))
    return t.select("doc_id", F.size("e").cast("long").alias("n"), digest("e"), F.array_join("g", "|").alias("graph_entities"), F.array_join("q", "|").alias("graph_numbers"))


def web_passages(spark, d):
    """Sentences of pages without navigation."""
    t = table(spark, d, "pages").select("page_id", W.passages(F.col("html")).alias("s"))
    return t.select("page_id", F.size("s").cast("long").alias("n"), digest("s"))


def atomic_claims(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.explode_outer(T.split_sentences(F.col("text"))).alias("claim")).where("claim is not null").select("doc_id", web.atomic_claims(F.col("claim")).alias("a"))
    return a.groupBy("doc_id").agg(F.count("*").alias("claims"), F.sum(F.size("a")).alias("atoms"), F.sum(F.length(F.array_join("a", ""))).alias("chars"))


def url_kinds(spark, d):
    """Pages by kind of site, and a DOI made of each url's number."""
    u = F.col("url")
    fake = F.concat(F.lit("https://www.doi.org/10.1234/x"), F.col("page_id").cast("string"), F.lit("?a"))
    return table(spark, d, "pages").select("page_id", W.host(u).alias("host"), W.is_encyclopedia(u).alias("encyclopedia"), W.is_unfetchable(u).alias("unfetchable"), W.is_paywalled(u).alias("paywalled"), W.is_academic(fake).alias("academic"), W.doi(fake).alias("doi"))


def answer_claims(spark, d):
    """Claims of assistant turns without refusals."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", W.claims_of(F.col("text"), T.split_sentences(F.col("text"))).alias("c"))
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("n"), digest("c"))


def token_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode_outer(X.token_chunks(F.col("text"))).alias("n", "chunk"))
    return c.select("doc_id", F.col("n").cast("long").alias("n"), F.sha2("chunk", 256).alias("digest"))


# Web profile: rules, verdicts, gates


def web_report(spark, d):
    return R.run_against(base.claims(spark, d), base.sources(spark, d), "of")


def web_signals(spark, d):
    """Signals of all claims by name and verdict. NUMERIC_CONTRADICTION has literal tests instead: places and contexts are beyond SQL."""
    rules = tuple(r for r in R.RULES if r != "NUMERIC_CONTRADICTION")
    ready = R.prepare_evidence(base.sources(spark, d)).select("of", *R.EVIDENCE)
    s = R.detect(R.prepare_claims(base.claims(spark, d)).join(ready, "of"), rules).select(F.explode_outer("signals").alias("s"))
    return s.groupBy(F.col("s.name").alias("name"), F.col("s.verdict").alias("verdict")).agg(F.count("*").alias("n"), V.exact_sum(F.col("s.score"), 3).alias("score"))


def web_verdicts(spark, d):
    """Claims of all sources by what the rules decide and whether a number conflict was seen."""
    x = web_report(spark, d).select(F.coalesce("verdict.status", F.lit("OPEN")).alias("status"), F.exists("signals", lambda s: s["name"] == "NUMERIC_CONTRADICTION").alias("numbers"))
    return x.groupBy("status", "numbers").agg(F.count("*").alias("n"))


#: (claim, evidence, rule that fires or null), derived by hand from the rules.
RULE_CASES = (
    ("The harbor festival attracted 500 visitors last summer", "The harbor festival attracted 300 visitors last summer according to the town.", "NUMERIC_CONTRADICTION"),
    ("The harbor festival attracted more than 200 visitors last summer", "The harbor festival attracted 300 visitors last summer according to the town.", None),
    ("The old bridge was opened in the 1990s for local traffic", "The old bridge was opened in 1995 for local traffic and trams.", None),
    ("The treaty was signed on March 3 1921 by both countries", "The treaty was signed on May 3 1921 by both countries involved.", "NUMERIC_CONTRADICTION"),
    ("The season ran 1998-99 with the same team in the league", "The season ran 1998-99 with the same team in the league again.", None),
    ("The season ran 1998-99 with the same team in the league", "The season ran in 1999 with the same team in the league again.", "NUMERIC_CONTRADICTION"),
    ("The town hall lies outside the medieval city walls.", "The town hall lies within the medieval city walls of the place.", "CONTRAST_CONTRADICTION"),
    ("The village is in the eastern part of the valley", "The village is located in the western part of the valley.", "CONTRAST_CONTRADICTION"),
    ("The company expanded its northern operations quickly", "The company contracted its northern operations quickly then.", "CONTRAST_CONTRADICTION"),
    ("The school is privately funded and well known", "The school is a publicly funded institution that is well known.", "CONTRAST_CONTRADICTION"),
    ("The station is not open during winter months", "The station is open during winter months for all travellers.", "NEGATION_CONTRADICTION"),
    ("The station is open during winter months", "The station is never open during winter months for travellers.", "NEGATION_CONTRADICTION"),
    ("The station is open not only during winter months", "The station is open during winter months for all travellers.", None),
    ("The opera was composed by Anna Keller", "The opera was composed by Peter Brandt and staged in spring.", "RELATION_CONTRADICTION"),
    ("The opera was directed by Anna Maria Keller", "The opera was produced by Anna Maria Keller and staged in spring.", "RELATION_CONTRADICTION"),
    ("The opera was composed by an American artist", "The opera was composed by Peter Brandt and staged in spring.", None),
    ("Riverside is a public school", "Riverside is a private school near the lake in the hills.", "TYPE_CONTRADICTION"),
    ("Morning Glass is a fictional apricot", "Morning Glass is a fictional character from a long running series.", "TYPE_CONTRADICTION"),
    ("Kestrel won the national sailing prize with great style", "Harrier won the national sailing prize with great style in June.", "ENTITY_SUBSTITUTION"),
    ("The method always finds the best route", "The method usually finds the best route through the network.", "HEDGING_MISMATCH"),
    ('She said "nothing was ever lost at sea" in an interview', "In an interview she said nothing was ever lost at sea by the fleet.", "QUOTE_MATCH"),
)


def web_rule_cases(spark, d):
    """Literal cases: whether the named rule fires, and for cases without a name that no contradiction does."""
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(RULE_CASES)], "id long, claim string, evidence string, rule string")
    s = R.run(rows)
    told = F.when(F.col("rule").isNull(), ~F.exists("signals", lambda x: x["verdict"] == "CONTRADICT")).otherwise(F.exists("signals", lambda x: (x["name"] == F.col("rule")) & x["verdict"].isin("CONTRADICT", "SUPPORT")))
    return s.select("id", "rule", told.alias("as_expected"))


def web_results(spark, d):
    """Results by source, made of labels: a spread of states and scores."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    k = F.col("doc_id")
    status = F.when(k % 17 == 0, "UNCITED").when(k % 13 == 0, "UNREACHABLE").when(F.col("toxic") == 1, "UNSUPPORTED").when(F.col("quality") == 1, "SUPPORTED").otherwise("UNVERIFIABLE")
    score = lambda a, m: F.when(k % m != 0, F.pmod(k * a, F.lit(101)) / 100.0)
    return x.select(F.concat_ws("-", "source", (k % 40).cast("string")).alias("answer_id"), status.alias("status"), score(37, 3).alias("support_score"), score(53, 5).alias("contradiction_score"), score(71, 7).alias("confidence"))


def web_gate_query(spark, d):
    res = web_results(spark, d)
    answers = res.select("answer_id").unionByName(spark.createDataFrame([("nothing",)], "answer_id string"))
    g = web_gate.acceptance_gate(answers, res, "answer_id")
    return g.select("answer_id", "decision", "label", r6("score").alias("score"), r6("risk").alias("risk"), "summary", F.array_join("failure_modes", "; ").alias("failure_modes"), F.size("policy").cast("long").alias("policy"))


web_gate_query.__name__ = "web_gate"


def web_status_counts(spark, d):
    return web_gate.status_counts(web_results(spark, d), "answer_id")


# Experiments


def run_rows(spark, d):
    """Run rows of all claims by top signal."""
    x = X.run_rows(base.expected(spark, d)).withColumn("label", (F.col("expected") == "SUPPORTED").cast("int"))
    return x.groupBy("signal", "decided", "pred", "label").agg(F.count("*").alias("n"))


def signal_accuracy(spark, d):
    x = X.run_rows(base.expected(spark, d)).withColumn("label", (F.col("expected") == "SUPPORTED").cast("int"))
    out = X.signal_accuracy(x)
    return out.select("signal", "correct", "total", r6("accuracy").alias("accuracy"), "kept")


def rejecting_precision(spark, d):
    x = X.run_rows(base.expected(spark, d)).withColumn("label", (F.col("expected") == "SUPPORTED").cast("int"))
    return X.rejecting_precision(x).select("signal", "n", r6("precision").alias("precision"))


def ablation(spark, d):
    """The engine without each rule: decided cases and accuracy on every claim of the documents."""
    ready = graph.with_signals(graph.meet(graph.prepare_claims(base.claims(spark, d)).join(graph.prepare_evidence(base.sources(spark, d)).select("of", *graph.EVIDENCE), "of")))
    ready = ready.withColumn("label", F.array_contains("sentences", F.col("claim")).cast("int"))
    return base._rounded(V.abstention_views(X.without_each(ready), "variant").select("variant", "view", "tp", "fp", "fn", "tn", "balanced_accuracy", "coverage", "n_decided"))


def predictions(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "labels").select(
        F.when(F.col("quality") == 1, "SUPPORTED").otherwise("UNSUPPORTED").alias("expected"), F.when(k % 5 == 0, "UNVERIFIABLE").when(F.col("toxic") == 1, "UNSUPPORTED").otherwise("SUPPORTED").alias("predicted"),
        F.when(k % 11 != 0, F.pmod(k * 37, F.lit(101)) / 100.0).alias("confidence"),
    )


def prediction_analysis(spark, d):
    return base._rounded(V.prediction_analysis(predictions(spark, d)))


def prediction_sweep(spark, d):
    return base._rounded(V.prediction_sweep(predictions(spark, d)).select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "far", "frr"))


def dataset_runs(spark, d):
    k = F.col("id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset"))
    return base.labelled_runs(spark, d).join(docs, "id").withColumns({"system": F.when(k % 3 == 0, "nli").when(k % 3 == 1, "tiered").otherwise("signals"), "tier": F.when(k % 2 == 0, "nli").otherwise("signals"), "latency_ms": F.pmod(k * 7919, F.lit(1009)) / 8.0})


def per_dataset(spark, d):
    return base._rounded(X.per_dataset(dataset_runs(spark, d)).select("dataset", "tp", "fp", "fn", "tn", "balanced_accuracy", "f1"))


def cost_summary(spark, d):
    return base._rounded(X.cost_summary(dataset_runs(spark, d)))


def tier_shares(spark, d):
    return X.tier_shares(dataset_runs(spark, d)).select("tier", "n", r6("share").alias("share"))


def hallucination_rates(spark, d):
    k = F.col("conv_id")
    c = table(spark, d, "conversations").where("role = 'assistant'").select(F.when(k % 2 == 0, "raw").otherwise("gated").alias("condition"), F.size(T.split_sentences(F.col("text"))).cast("long").alias("claims"), (F.size(T.split_sentences(F.col("text"))) > 2).cast("long").alias("unsupported"), (k % 3).alias("regenerations"), (k % 4 == 0).alias("blocked"), (k % 5).alias("caught"))
    return X.hallucination_rates(c).select("condition", "claims", "unsupported", "regenerations", "blocked", "caught", r6("rate").alias("rate"))


def gate_comparison(spark, d):
    """What the graph gate changes against no gate, over all claims."""
    x = base.expected(spark, d).where("expected = 'UNSUPPORTED'").agg(F.count("*").alias("unsupported"), F.count_if(F.col("decision") == "REJECT").alias("rejected"), F.count_if(F.col("decision") == "ACCEPT").alias("false_accepts"))
    return base._rounded(web_gate.comparison(x))


def last_turn(spark, d):
    """Each conversation's last row, joined back to its documents' order of ids."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "role")
    return X.rebuilt(c.select("id").distinct(), c, "id", "turn").select("id", "role")


def benchmark_view(spark, d):
    """Labelled cases with predictions where there are any, one page of the wrong ones."""
    cases = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    k = F.col("id")
    told = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "UNSUPPORTED").otherwise("SUPPORTED").alias("predicted"), F.when(F.col("quality") == 1, "SUPPORTED").otherwise("UNSUPPORTED").alias("expected"))
    both = X.with_results(cases, X.of_ids(told, cases.where(k >= 0)))
    return X.view(both.where("done"), "wrong", 0, 50)


# Graphs as tensors, tables


def node_features(spark, d):
    """Sums of all claims' node features by place."""
    v = base.verified(spark, d).withColumn("f", tensors.feature_rows(F.col("nodes"), F.col("support_score"), F.col("contradiction_score")))
    return tensors.place_sums(v).select(F.col("place").cast("long").alias("place"), F.round("x", 3).alias("x"), "n")


def edge_places(spark, d):
    """Edges between nodes by the source's place."""
    e = base.verified(spark, d).select(F.explode_outer(tensors.edge_index(F.col("nodes"), F.col("edges"))).alias("e"))
    return e.groupBy(F.col("e.src").cast("long").alias("src")).agg(F.count("*").alias("n"), F.round(F.sum("e.weight"), 3).alias("weight"))


def message_sums(spark, d):
    """One step of message passing over vectors of a label, each to the next one by id."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("case"), F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    edges = e.where("case != 0").select("case", F.col("pos").alias("src"), (F.col("pos") + 1).alias("dst"), F.lit(0.5).alias("weight")).join(e.select("case", F.col("pos").alias("dst")), ["case", "dst"])
    m = tensors.message_pass(e, edges)
    return m.select("case", "pos", F.round(F.aggregate("message", F.lit(0.0), lambda a, x: a + x), 4).alias("message"))


def monotone_pairs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), F.col("label").alias("case"))
    aligned = vectors.best_in_blocks(e, e.select((F.col("case") + 1).cast(dict(e.dtypes)["case"]).alias("case"), "pos", "vec"))
    return base._rounded(vectors.monotone_share(aligned).select(F.col("case").cast("long").alias("label"), "share"))


def dataset_hash(spark, d):
    pairs = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("claim"), F.lit(1).alias("label"), F.col("item_id").alias("n"))
    return spark.createDataFrame([(io.dataset_hash(pairs, "n"),)], "hash string")


def breakdown_table(spark, d):
    """Lines of the table of balanced accuracy by dataset and system."""
    runs = dataset_runs(spark, d)
    m = V.core_metrics(runs, "dataset", "system").select("dataset", "system", "balanced_accuracy")
    return tables.breakdown_rows(m, ["signals", "nli", "tiered"])


MORE = (
    web_tokens, web_entities, web_passages, atomic_claims, url_kinds, answer_claims, token_chunks, web_signals, web_verdicts, web_rule_cases, web_gate_query, web_status_counts, run_rows, signal_accuracy, rejecting_precision, ablation,
    prediction_analysis, prediction_sweep, per_dataset, cost_summary, tier_shares, hallucination_rates, gate_comparison, last_turn, benchmark_view, node_features, edge_places, message_sums, monotone_pairs, dataset_hash, breakdown_table,
)
QUERIES = {f.__name__: f for f in MORE}

# SQL

_JS = W.SPACE
_wcollapse = lambda t: f"trim(regexp_replace({t}, '{_JS}+', ' ', 'g'))"
_wnorm = lambda t: rf"trim(regexp_replace(strip_accents(lower({t})), '[^a-z0-9.\"''%-]+', ' ', 'g'))"
_wtok = lambda n: f"list_filter(regexp_extract_all({n}, '[a-z0-9]{{3,}}'), lambda w: not list_contains({Q.STOP}, w))"
_wsent = lambda t: f"list_filter(list_transform(regexp_extract_all({_wcollapse(t)}, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: trim(s)), lambda s: len(s) > 20)"
_NAV = r"(?i)^\s*(?:skip to|jump to|table of contents|menu|navigation|breadcrumb|cookie|privacy|terms of|log ?in|sign ?up|subscribe|newsletter)"
_wpass = lambda t: rf"list_filter({_wsent(t)}, lambda s: not (regexp_matches(s, '^\s*\[.*\]\(https?://') or len(regexp_extract_all(s, 'https?://')) >= 3 or regexp_matches(s, '{_NAV}')))"
_wents = lambda t: f"list_filter(regexp_extract_all({t}, '\\b[A-Z][a-z]+(?:{_JS}+[A-Z][a-z]+)*'), lambda e: len(e) > 2 and not list_contains({Q.strings(W.BLOCKED_ENTITIES)}, lower(e)))"
_first = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"
_wclip = lambda t, n: f"case when len({_wcollapse(t)}) <= {n} then {_wcollapse(t)} else trim(({_wcollapse(t)})[:{n - 1}]) || '...' end"

_WEB = f"""
wev as materialized (select "of", coalesce(evidence, '') evidence, {_wnorm("coalesce(evidence, '')")} en, {_wpass("coalesce(evidence, '')")} ess from src),
wsets as materialized (select *, list_transform(ess, lambda s: list_distinct({_wtok(_wnorm('s'))})) es from wev),
wtok as materialized (select *, {_wtok(_wnorm('claim'))} ct, {_wnorm('claim')} cn from pair join wsets using ("of")),
wwin as (select cid, i - 1 "position", c, list_distinct(list_concat(es[i], coalesce(es[i + 1], []))) wt from (select cid, list_distinct(ct) c, es, unnest(range(1, len(es) + 1)) i from wtok where len(ct) > 0)),
wsc as (select cid, "position", h / greatest(n, 1) cov, h / greatest(m, 1) den from (select cid, "position", len(list_intersect(c, wt)) h, len(c) n, len(wt) m from wwin)),
wbest as (select cid, "position", cov from wsc qualify row_number() over (partition by cid order by greatest(0.0, least(1.0, cov * 0.78 + least(den * 3, 1.0) * 0.22)) desc, "position") = 1),
wsig as materialized (select wtok.*, coalesce(cov, 0.0) cov, case when b.cid is null then {_wclip('evidence[:2000]', 520)} else {_wclip('''ess["position" + 1] || coalesce(' ' || ess["position" + 2], '')''', 520)} end pt,
  case when len(ct) >= 5 then len(list_filter(range(1, len(ct) - 3), lambda i: contains(en, array_to_string(ct[i:i + 4], ' ')))) / (len(ct) - 4) else 0.0 end lex from wtok left join wbest b using (cid)),
went as materialized (select cid, cov, lex, evidence, en, claim, ct, pt, list_distinct({_wtok(_wnorm('pt'))}) ps, {_first(_wents('claim'))} ce, {_first(_wents('pt'))} pe from wsig)"""
_NE = lambda e: rf"trim(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_GONE = f"""len(list_filter(ce, lambda x: len({_NE('x')}) >= 4 and not list_contains(list_transform(pe, lambda y: {_NE('y')}), {_NE('x')})
    and len(list_filter(string_split({_NE('x')}, ' '), lambda t: len(list_filter(pe, lambda y: contains({_NE('y')}, t) or contains(t, {_NE('y')}))) > 0)) = 0
    and len(list_filter(ct, lambda t: t <> {_NE('x')} and not list_contains(string_split({_NE('x')}, ' '), t))) >= 4
    and len(list_filter(ct, lambda t: t <> {_NE('x')} and not list_contains(string_split({_NE('x')}, ' '), t) and list_contains(ps, t))) >= 0.55 * len(list_filter(ct, lambda t: t <> {_NE('x')} and not list_contains(string_split({_NE('x')}, ' '), t))))) > 0"""
_phr = lambda ps, t: f"len(list_filter({Q.strings(ps)}, lambda p: contains(lower({t}), p))) > 0"

_RES = """
res as (select source || '-' || (doc_id % 40) answer_id, case when doc_id % 17 = 0 then 'UNCITED' when doc_id % 13 = 0 then 'UNREACHABLE' when toxic = 1 then 'UNSUPPORTED' when quality = 1 then 'SUPPORTED' else 'UNVERIFIABLE' end status,
  case when doc_id % 3 <> 0 then (doc_id * 37 % 101) / 100.0::double end s, case when doc_id % 5 <> 0 then (doc_id * 53 % 101) / 100.0::double end c, case when doc_id % 7 <> 0 then (doc_id * 71 % 101) / 100.0::double end f
  from labels join (select doc_id, source from documents) using (doc_id))"""
_PRED = "pred as (select case when quality = 1 then 'SUPPORTED' else 'UNSUPPORTED' end e, case when doc_id % 5 = 0 then 'UNVERIFIABLE' when toxic = 1 then 'UNSUPPORTED' else 'SUPPORTED' end p, case when doc_id % 11 <> 0 then (doc_id * 37 % 101) / 100.0::double end c from labels)"
_DRUNS = "runs as (select doc_id id, source dataset, quality y, 1 - toxic p, doc_id % 2 = 0 decided, case doc_id % 3 when 0 then 'nli' when 1 then 'tiered' else 'signals' end system, case when doc_id % 2 = 0 then 'nli' else 'signals' end tier, (doc_id * 7919 % 1009) / 8.0::double ms from labels join (select doc_id, source from documents) using (doc_id))"
_TOP = "case when least(length(evidence) / 2000, 1) >= greatest(lex, cover) then 'SOURCE_RETRIEVAL' when lex >= cover then 'LEXICAL_OVERLAP' else 'EVIDENCE_COVERAGE' end"
_RUNROWS = f"rr as (select {_TOP} signal, decision in ('ACCEPT', 'REJECT') decided, (decision = 'ACCEPT')::int pred, list_contains(ess, claim)::int label from verdict)"
_ABL = f"""
abl as (select v variant, list_contains(ess, claim)::int y, coverage cov,
  greatest((case when lex >= 0.6 and v <> 'LEXICAL_OVERLAP' then lex * 0.20 else 0 end + case when cover >= 0.65 and v <> 'EVIDENCE_COVERAGE' then cover * 0.17 else 0 end) / greatest(case when lex >= 0.6 and v <> 'LEXICAL_OVERLAP' then 0.20 else 0 end + case when cover >= 0.65 and v <> 'EVIDENCE_COVERAGE' then 0.17 else 0 end, 0.01),
    coalesce(list_sum(u), 0) / greatest(len(u), 1)) sup,
  least(1.0, greatest(case when len(nums) > len(fnums) then 0.78 else 0 end, case when len(ents) > len(fents) then 0.35 * 0.45 else 0 end, case when length(evidence) <= 200 and v <> 'SOURCE_RETRIEVAL' then least(length(evidence) / 2000, 1) * 0.08 * 0.45 else 0 end, case when cover <= 0.18 and v <> 'EVIDENCE_COVERAGE' then cover * 0.17 * 0.45 else 0 end)) con
  from (select *, list_concat(list_concat(gcov, list_transform(fents, lambda x: 0.9)), list_concat(list_transform(fnums, lambda x: 0.9), list_concat(case when lex >= 0.6 and v <> 'LEXICAL_OVERLAP' then [lex * 0.20] else [] end, case when cover >= 0.65 and v <> 'EVIDENCE_COVERAGE' then [cover * 0.17] else [] end))) u
    from (select * from verdict where "of" in (select "of" from src)), (values ('full'), ('SOURCE_RETRIEVAL'), ('LEXICAL_OVERLAP'), ('EVIDENCE_COVERAGE')) n(v))),
dec as (select *, case when con >= 0.78 then 'REJECT' when cov < 0.18 then 'ABSTAIN' when sup >= 0.78 and cov >= 0.74 and con < 0.25 then 'ACCEPT' else 'REVISE' end d from abl),
vw as (select variant, w, y, d in ('ACCEPT', 'REJECT') decided, case when d in ('ACCEPT', 'REJECT') then (d = 'ACCEPT')::int when w = 'accept' then 1 when w = 'escalate' then 0 end p from dec, (values ('decided'), ('accept'), ('escalate')) n(w)),
ag as (select variant, w "view", {base._GRADE}, avg(decided::int) coverage, count(*) filter (decided) n_decided from vw group by 1, 2)"""

ORACLE = {
    "web_tokens": f"select doc_id, len(t) n, sha256(array_to_string(t, '|')) digest from (select doc_id, {_wtok(_wnorm('text'))} t from documents)",
    "web_entities": f"""select doc_id, len(e) n, sha256(array_to_string(e, '|')) digest, array_to_string(g, '|') graph_entities, array_to_string(q, '|') graph_numbers from (select doc_id, {_first('e0')} e,
list_filter({_first('g0')}, lambda x: not list_contains({Q.strings(W.GRAPH_BLOCKED)}, x))[1:8] g, {_first('q0')}[1:8] q from (select doc_id, {_wents('text')} e0, regexp_extract_all(text, '\\b[A-Z][a-z]+(?:{_JS}+[A-Z][a-z]+){{0,3}}') g0, list_transform(regexp_extract_all(text, '{W.GRAPH_NUMBER}'), lambda x: replace(x, ',', '')) q0 from documents))""",
    "web_passages": f"select page_id, len(s) n, sha256(array_to_string(s, '|')) digest from (select page_id, {_wpass('html')} s from pages)",
    "atomic_claims": rf"""with c as (select doc_id, unnest({Q.sentences('text')}) claim from documents), p as (select doc_id, claim, string_split_regex(claim, '(?i)\b(?:and|as well as|in addition to|while also|additionally)\b') ps from c),
a as (select doc_id, case when len(ps) <= 1 then [trim(claim)] else list_filter(list_transform(ps, lambda x: trim(x)), lambda x: len(x) > 15 and len({_wtok(_wnorm('x'))}) >= 3) end a from p)
select doc_id, count(*) claims, sum(len(a))::bigint atoms, sum(len(array_to_string(a, '')))::bigint chars from a group by 1""",
    "url_kinds": r"""select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^(.*?)www\.', '\1') host, regexp_matches(url, '^https?://(en|www)\.wikipedia\.org/wiki/') encyclopedia,
regexp_matches(url, '://[^/]*(?:youtube\.com|youtu\.be|twitter\.com|x\.com|instagram\.com|tiktok\.com|facebook\.com)') unfetchable, regexp_matches(url, '://[^/]*(?:nature\.com|sciencedirect\.com|springer\.com|wiley\.com|tandfonline\.com|jstor\.org|cell\.com|sciencemag\.org|science\.org)') paywalled, true academic, '10.1234/x' || page_id doi from pages""",
    "answer_claims": rf"""with s as (select conv_id, turn, text, {Q.sentences('text')} ss from conversations where role = 'assistant'), c as (select conv_id, turn, list_filter(case when len(ss) > 0 then ss when trim(text) <> '' then [trim(text)] else [] end, lambda x: len(list_filter({Q.strings(W.REFUSALS)}, lambda m: contains(lower(x), m))) = 0) c from s)
select conv_id, turn, len(c) n, sha256(array_to_string(c, '|')) digest from c""",
    "token_chunks": f"""with w as (select doc_id, text, list_filter(string_split_regex(text, '{T.SPACE}+'), lambda x: x <> '') w from documents), c as (select doc_id, case when len(w) > 400 then list_transform(list_filter(range(0, len(w), 200), lambda a: a = 0 or (a + 200 < len(w) and len(w) - a >= 50)), lambda a: array_to_string(w[a + 1:a + 400], ' ')) else [text] end c from w)
select doc_id, unnest(range(0, len(c))) n, sha256(unnest(c)) digest from c""",
    "web_signals": f"""with {Q.PAIRS}, {_WEB}, f as (
select 'SOURCE_RETRIEVAL' "name", case when length(evidence) > 200 then 'NEUTRAL' else 'INSUFFICIENT' end verdict, least(length(evidence) / 2000, 1.0) s from went
union all select 'LEXICAL_OVERLAP', case when lex >= 0.6 then 'SUPPORT' else 'NEUTRAL' end, lex from went
union all select 'EVIDENCE_COVERAGE', case when cov >= 0.65 then 'SUPPORT' when cov <= 0.18 then 'INSUFFICIENT' else 'NEUTRAL' end, cov from went
union all select 'QUOTE_MATCH', case when hit then 'SUPPORT' else 'INSUFFICIENT' end, case when hit then 0.97 else 0.15 end from (select contains(en, {_wnorm("regexp_extract(claim, '\"([^\"]{8,})\"', 1)")}) hit from went where regexp_matches(claim, '"[^"]{{8,}}"'))
union all select 'HEDGING_MISMATCH', 'CONTRADICT', 0.62 from went where {_phr(R.HEDGING_STRONG, 'claim')} and {_phr(R.HEDGING_WEAK, 'pt')}
union all select 'ENTITY_SUBSTITUTION', 'CONTRADICT', 0.72 from went where len(pe) > 0 and {_GONE})
select name, verdict, count(*) n, round(sum(s), 3) score from f group by 1, 2""",
    "web_rule_cases": "select * from (values " + ", ".join(f"({i}::bigint, {'null' if c[2] is None else repr(c[2])}, true)" for i, c in enumerate(RULE_CASES)) + ") t(id, rule, as_expected)",
    "web_gate": f"""with {_RES}, sc as (select *, case status when 'SUPPORTED' then least(1, greatest(0, greatest(coalesce(s, f, 0.88), 0.75))) when 'UNSUPPORTED' then least(1, greatest(0, coalesce(s, 0.1))) when 'UNREACHABLE' then 0 else 0.3 end sup,
  case status when 'SUPPORTED' then coalesce(c, 0) when 'UNSUPPORTED' then coalesce(c, f, 0.82) else 0 end con, (status not in ('SUPPORTED', 'UNSUPPORTED'))::int un from res where status <> 'UNCITED'),
ag as (select answer_id, count(*) total, count(*) filter (status = 'SUPPORTED') g, count(*) filter (status = 'UNSUPPORTED') b, count(*) filter (status = 'UNREACHABLE') l, coalesce(avg(sup) filter (status <> 'UNREACHABLE'), 0) mean, max(con) most, coalesce(avg(un) filter (status <> 'UNREACHABLE'), 1) un from sc group by 1),
a as (select answer_id, coalesce(total, 0) total, coalesce(g, 0) g, coalesce(b, 0) b, coalesce(l, 0) l, most, un, case when total > 0 then least(1, greatest(0, mean - (most * 0.55 + un * 0.15))) else 0 end score from (select distinct answer_id from res union select 'nothing') left join ag using (answer_id)),
r as (select *, case when total > 0 then least(1, greatest(0, 1 - score + most * 0.3)) else 1 end risk, case when total = 0 then 0 when b > 0 and most >= 0.78 then 1 when b > 0 then 2 when total = l then 3 when un > 0.5 and g = 0 then 4 when score >= 0.72 and g >= (total - l) * 0.7 then 5 when g > 0 and g >= (total - l) * 0.5 then 5 else 6 end k from a),
n as (select *, ['ABSTAIN', 'REJECT', 'REVISE', 'ABSTAIN', 'ABSTAIN', 'ACCEPT', 'REVISE'][k + 1] decision, l || ' source' || case when l = 1 then '' else 's' end lost from r), m as (select *, case when l > 0 then ' (' || lost || ' unreachable)' else '' end note from n)
select answer_id, decision, ['No citations', 'Blocked', 'Needs revision', 'No evidence', 'Insufficient evidence', 'Accepted', 'Borderline'][k + 1] label, round(score, 6) score, round(risk, 6) risk,
case when total = 0 then 'No cited claims were available for verification.' when decision = 'ACCEPT' then g || ' of ' || total || ' citations verified against sources (' || floor(score * 100 + 0.5)::int || '% confidence)' || note || '.' when decision = 'REJECT' then b || ' citation' || case when b = 1 then '' else 's' end || ' contradicted by source evidence (' || floor(risk * 100 + 0.5)::int || '% risk)' || note || '.'
  when decision = 'ABSTAIN' then 'Could not retrieve enough evidence to verify claims' || note || '.' else g || ' of ' || (total - l) || ' verifiable citations supported (' || floor(score * 100 + 0.5)::int || '% score)' || note || '.' end summary,
array_to_string(list_filter([['No citations supplied', 'High-confidence contradiction found', 'At least one citation does not support its claim', 'No sources could be retrieved', 'Too many claims could not be verified', null, 'Support score below acceptance threshold'][k + 1], case when l > 0 then lost || ' could not be retrieved' end], lambda x: x is not null), '; ') failure_modes, 5::bigint "policy" from m""",
    "web_status_counts": f"with {_RES} select answer_id, count(*) filter (status = 'SUPPORTED') verified, count(*) filter (status = 'UNSUPPORTED') flagged, count(*) filter (status = 'UNVERIFIABLE') uncertain, count(*) filter (status = 'UNREACHABLE') unreachable from res group by 1",
    "run_rows": f"with {Q.PAIRS}, {Q.VERIFIED}, {_RUNROWS} select signal, decided, pred, label, count(*) n from rr group by all",
    "signal_accuracy": f"with {Q.PAIRS}, {Q.VERIFIED}, {_RUNROWS} select signal, count(*) filter (pred = label) correct, count(*) total, round(avg((pred = label)::int), 6) accuracy, true kept from rr where decided group by 1",
    "rejecting_precision": f"with {Q.PAIRS}, {Q.VERIFIED}, {_RUNROWS} select signal, count(*) n, round(avg((label = 0)::int), 6) \"precision\" from rr where decided and pred = 0 group by 1",
    "ablation": f"with {Q.PAIRS}, {Q.VERIFIED}, {_ABL} select variant, \"view\", tp, fp, fn, tn, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) balanced_accuracy, round(coverage, 6) coverage, n_decided from ag",
    "prediction_analysis": f"with {_PRED}, x as (select (e = 'SUPPORTED')::int y, case when p <> 'UNVERIFIABLE' then (p = 'SUPPORTED')::int end p from pred), sums as (select {base._GRADE}, avg((p is null)::int) ab, count(*) n from x), rates as (select *, {base._RATES} from sums) select {base._FINAL.replace('round(far, 6) far', 'case when fn + tn > 0 then round(far, 6) else 0 end far')}, round(ab, 6) abstention_rate, n, round(accuracy, 6) coverage_conditioned_accuracy from rates",
    "prediction_sweep": f"with {_PRED}, x as (select t / 20.0::double threshold, (e = 'SUPPORTED')::int y, (not (p = 'UNSUPPORTED' and coalesce(c, 0.5) >= t / 20.0::double))::int p from pred, range(0, 21) r(t) where p <> 'UNVERIFIABLE'), sums as (select threshold, {base._GRADE} from x group by 1), rates as (select *, {base._RATES} from sums) select threshold, tp, fp, fn, tn, round(\"precision\", 6) \"precision\", round(recall, 6) recall, round(coalesce(2 * \"precision\" * recall / nullif(\"precision\" + recall, 0), 0), 6) f1, round(far, 6) far, round(frr, 6) frr from rates",
    "per_dataset": f"with {_DRUNS}, f as (select dataset, y, case when decided then p else 1 end p from runs), b as (select * from f union all select null, y, p from f), sums as (select dataset, {base._GRADE} from b group by 1), rates as (select *, {base._RATES} from sums) select dataset, tp, fp, fn, tn, round(balanced_accuracy, 6) balanced_accuracy, round(coalesce(2 * \"precision\" * recall / nullif(\"precision\" + recall, 0), 0), 6) f1 from rates",
    "cost_summary": f"with {_DRUNS}, c as (select system, count(*) n, avg(ms) m, list_sort(list(ms))[count(*) // 2 + 1] p50, avg(case system when 'nli' then 184000000 when 'tiered' then case when tier = 'nli' then 184000000 else 0 end else 0 end) pr from runs group by 1) select system, n, round(m, 6) ms_per_claim_mean, round(p50, 6) ms_per_claim_p50, round(pr, 6) param_invocations_per_claim, round(m * 1000, 6) ms_per_1k_claims from c",
    "tier_shares": f"with {_DRUNS} select tier, count(*) n, round(count(*) / (select count(*) from runs), 6) share from runs group by 1",
    "hallucination_rates": f"with c as (select conv_id k, len({Q.sentences('text')}) n from conversations where role = 'assistant'), s as (select case when k % 2 = 0 then 'raw' else 'gated' end condition, sum(n)::bigint claims, sum((n > 2)::int)::bigint unsupported, sum(k % 3)::bigint regenerations, sum((k % 4 = 0)::int)::bigint blocked, sum(k % 5)::bigint caught from c group by 1) select *, round(unsupported / claims, 6) rate from s",
    "gate_comparison": f"with {Q.PAIRS}, {Q.VERIFIED}, s as (select count(*) u, count(*) filter (decision = 'REJECT') r, count(*) filter (decision = 'ACCEPT') f from verdict where not list_contains(ess, claim)) select u unsupported, r rejected, f false_accepts, u - r - f abstained, 1.0::double baseline_false_accept_rate, round(coalesce(f / nullif(r + f, 0), 0), 6) far_of_decided, round(f / u, 6) far_of_all, round(1 - f / u, 6) false_accept_reduction, round(r / u, 6) intercepted_share, round((u - f) / u, 6) intercepted_or_routed_share from s",
    "last_turn": "select conv_id id, role from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1",
    "benchmark_view": "select doc_id id, case when toxic = 1 then 'UNSUPPORTED' else 'SUPPORTED' end predicted, case when quality = 1 then 'SUPPORTED' else 'UNSUPPORTED' end expected, true done from labels where doc_id in (select doc_id from documents) and (toxic = 1) <> (quality <> 1) order by doc_id limit 50",
    "message_sums": "with e as (select label c, vec_id p, list_sum(embedding::double[]) s from embeddings), m as (select c, avg(s) m from e where c = 0 group by 1) select e.c::bigint \"case\", e.p pos, round(case when e.c = 0 then m.m else coalesce(b.s * 0.5, 0) end, 4) message from e left join e b on b.c = e.c and b.p = e.p - 1 left join m on m.c = e.c",
    "monotone_pairs": "with v as (select vec_id, label, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings), p as (select a.label, a.vec_id, s.vec_id v, list_inner_product(a.e, s.e) / (a.n * s.n) c from v a join v s on a.label = s.label + 1), b as (select label, vec_id, v from p qualify row_number() over (partition by vec_id order by c desc, v) = 1), l as (select label, v, lag(v) over (partition by label order by vec_id) w from b) select label::bigint label, round(case when count(w) > 0 then count(*) filter (v >= w) / count(w) else 1 end, 6) share from l group by 1",
    "dataset_hash": "select sha256(string_agg(item_id || coalesce(text, '') || '1', '' order by item_id))[:16] hash from benchmark",
    "breakdown_table": f"with {_DRUNS}, sums as (select dataset, system, {base._GRADE} from runs group by 1, 2), rates as (select *, {base._RATES} from sums), f as (select dataset, system, printf('%.1f', round_even(balanced_accuracy * 100, 1)) v from rates) select dataset, coalesce(max(v) filter (system = 'signals'), 'nan') signals, coalesce(max(v) filter (system = 'nli'), 'nan') nli, coalesce(max(v) filter (system = 'tiered'), 'nan') tiered from f group by 1",
}
