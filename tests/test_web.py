"""The web profile: text functions, rules, tiers, gates, answers, graphs on literal cases."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import web
from claimloom.functions import web_text as W
from claimloom.operators import web_gate as G
from claimloom.operators import web_rules as R
from claimloom.plans import more


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "made, want",
    [
        (lambda: W.normalize(lit("Café  déjà vu, ﬁne… Ünïcødé “q”")), "cafe deja vu fine... unic de q"),
        (lambda: W.tokenize(lit("The cafés of Köln")), ["cafes", "koln"]),
        (lambda: W.clip(lit("a" * 10), 8), "aaaaaaa..."),
        (lambda: W.extract_entities(lit("However, Paris met New York City and Paris. At")), ["Paris", "New York City"]),
        (lambda: W.graph_numbers(lit("50%x and 1,990 and 3.5 and 1,990")), ["50%", "1990", "3.5"]),
        (lambda: W.graph_relations(lit("It was written by Ann Lee; produced by Bo.")), ["written by Ann Lee", "produced by Bo"]),
        (lambda: W.is_navigation(lit("Skip to content and more")), True),
        (lambda: W.is_navigation(lit("A plain sentence about menus")), False),
        (lambda: W.singular(lit("companies")), "company"),
        (lambda: W.singular(lit("actresses")), "actress"),
        (lambda: W.singular(lit("glass")), "glass"),
        (lambda: W.type_object(lit("it is a public school in the town")), "public school"),
        (lambda: W.type_object(lit("nothing here")), None),
        (lambda: W.clean_rewrite(lit('\n Rewrite: "It is so."\nmore')), "It is so."),
        (lambda: W.listed_facts(lit("1. The first fact here\n- short\n* The second fact is\n"), lit("c")), ["The first fact here", "The second fact is"]),
        (lambda: W.listed_facts(lit("none"), lit("c")), ["c"]),
        (lambda: W.doi(lit("https://doi.org/10.1000/xyz?a=1")), "10.1000/xyz"),
        (lambda: W.doi(lit("https://www.nature.com/articles/s41586-020-2649-2")), "10.1038/s41586-020-2649-2"),
        (lambda: W.is_unfetchable(lit("https://www.netflix.com/x")), True),  # `x.com` is found in it
        (lambda: W.is_academic(lit("https://export.arxiv.org/abs/1")), True),
        (lambda: W.is_encyclopedia(lit("https://en.wikipedia.org/wiki/Sea")), True),
        (lambda: W.search_query(lit("word|" * 40)), " ".join(["word"] * 30)),
        (lambda: W.words_met(("public", "private", "worsen"), F.array(lit("privately"), lit("publics"), lit("worse"))), ["public", "private", "worsen"]),
        (lambda: W.claims_of(lit("ok"), F.array().cast("array<string>")), ["ok"]),
        (lambda: W.claims_of(lit("x"), F.array(lit("I cannot tell you that now."), lit("The sea is deep and wide."))), ["The sea is deep and wide."]),
        (lambda: web.clean_page(lit("[a](https://x.org/b) see http://u.v/w\n\n\n\nend")), "a see \n\nend"),
        (lambda: web.assemble(lit("u"), lit("p" * 81), lit("s")), "--- SOURCE (u) ---\n" + "p" * 81 + "\n\n--- WEB SEARCH ---\ns"),
        (lambda: web.assemble(lit("u"), lit("short"), lit(None).cast("string")), None),
        (lambda: web.align_claims(lit("Sea is [[1] deep. Sky is very blue [1] yes"), F.array(lit("u"))), ["Sky is very blue"]),
        (lambda: web.align_claims(lit("No markers here at all"), F.array(lit("u"))), [None]),
        (lambda: web.atomic_claims(lit("The tower stands in Paris and it was built by Eiffel")), ["The tower stands in Paris"]),
        (lambda: web.atomic_claims(lit(" One claim only ")), ["One claim only"]),
    ],
)
def test_functions(spark, made, want):
    assert value(spark, made()) == want


def test_verdicts_of_judges(spark):
    raw = ['Sure: {"verdict": "UNSUPPORTED", "corrected": "c", "sourceExcerpt": "e"} done', '{"verdict": "MAYBE"}', "no json", '{"verdict":', ""]
    got = [r.v for r in spark.createDataFrame([(x,) for x in raw], "r string").select(W.parse_verdict(F.col("r")).alias("v")).collect()]
    assert got[0].status == "UNSUPPORTED" and got[0].corrected == "c" and [g.status for g in got[1:]] == ["UNVERIFIABLE"] * 4


def test_rules_on_literal_cases(spark):
    got = {r.id: r.as_expected for r in more.web_rule_cases(spark, "").collect()}
    assert [more.RULE_CASES[i] for i, ok in got.items() if not ok] == []


def test_number_mentions():
    told = [(m["normalized"], m["kind"], m["comparator"]) for m in R.number_mentions("More than 1,990 ships in the 1980s; three came 2nd")]
    assert told == [("1990", "exact", "gte"), ("1980", "decade", "gte"), ("3", "word", "gte"), ("2", "exact", "exact")]
    assert [m["normalized"] for m in R.number_mentions("1998-99")] == ["1998", "99", "1999"]
    assert [m["normalized"] for m in R.number_mentions("one point two, 3 . 5")] == ["2", "3.5"]
    assert R.month_dates("On May 3rd, 1999 and june 4") == [(5, 3, 1999, "may 3rd 1999"), (6, 4, None, "june 4")]
    assert R.is_title_year("1984 Tells a story", R.number_mentions("1984 Tells a story")[0])
    assert R.number_conflict("The 19th century tower stands in the old town", "The tower stands in the old town since 1850.") is None
    assert R.number_conflict("", "1") is None


def test_verdict_thresholds(spark):
    """Contradiction from .82, a quote from .95, coverage from .86 under .2 of contradiction, overlap from .72 with coverage from .62."""
    s = lambda name, verdict, score: (name, "", verdict, score, 0.2, "", "e")
    cases = [
        ([s("X", "CONTRADICT", 0.82)], 0.9, 0.82, "UNSUPPORTED"), ([s("X", "CONTRADICT", 0.81)], 0.9, 0.81, None), ([s("QUOTE_MATCH", "SUPPORT", 0.95)], 0.0, 0.0, "SUPPORTED"), ([s("QUOTE_MATCH", "SUPPORT", 0.94)], 0.0, 0.0, None),
        ([], 0.86, 0.19, "SUPPORTED"), ([], 0.86, 0.2, None), ([], 0.85, 0.0, None), ([s("LEXICAL_OVERLAP", "SUPPORT", 0.72)], 0.62, 0.5, "SUPPORTED"), ([s("LEXICAL_OVERLAP", "SUPPORT", 0.71)], 0.62, 0.0, None),
        ([s("LEXICAL_OVERLAP", "SUPPORT", 0.72)], 0.61, 0.0, None),
    ]
    rows = [(i, x, c, k, 0.5, [("w", 0.1, 0.1, 0)]) for i, (x, c, k, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, signals array<struct<name:string,label:string,verdict:string,score:double,weight:double,rationale:string,evidence:string>>, evidence_coverage double, contradiction_score double, support_score double, windows array<struct<text:string,overlap:double,coverage:double,position:int>>")
    got = {r.id: r.verdict and r.verdict.status for r in R.verdict(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


PAIRS = [
    ("a", "The harbor festival attracted 500 visitors last summer", "The harbor festival attracted 300 visitors last summer according to the town."),
    ("b", "The old harbor is open during the long winter months", "The old harbor is open during the long winter months for everyone."),
    ("c", "The mountain railway climbs steeply towards seven alpine villages", "The mountain railway is a popular line that many people like to ride in summer."),
    ("d", "Nothing in common with it", "Completely different words stand here alone."),
]


def test_cascade_asks_each_tier_for_open_rows_alone(spark):
    df = R.run(spark.createDataFrame(PAIRS, "id string, claim string, evidence string"))
    asked = {}

    def model(rows):
        asked["model"] = {r.id for r in rows.select("id").collect()}
        return rows.select("id", F.lit("UNSUPPORTED").alias("model_status"), F.when(F.col("id") == "c", 0.9).otherwise(0.5).alias("model_confidence"))

    def judge(rows):
        asked["judge"] = {r.id for r in rows.select("id").collect()}
        return rows.select("id", F.lit('{"verdict": "UNSUPPORTED", "corrected": "x"}').alias("judge_raw"))

    got = {r.id: r for r in G.cascade(df, model, judge).collect()}
    assert asked == {"model": {"c", "d"}, "judge": {"d"}}
    assert {k: (r.status, r.tier) for k, r in got.items()} == {"a": ("UNSUPPORTED", 1), "b": ("SUPPORTED", 1), "c": ("UNSUPPORTED", 2), "d": ("UNSUPPORTED", 3)}
    assert got["c"].support_score <= 0.25 and got["c"].contradiction_score == 0.9 and got["c"].signals[-1].name == "NLI_MODEL"
    assert got["d"].confidence == 0.84 and got["d"].corrected == "x" and got["d"].signals[-1].name == "LLM_JUDGE"
    alone = {r.id: (r.status, r.tier, r.confidence) for r in G.cascade(df).collect()}
    assert alone["c"] == ("SUPPORTED", 3, 0.58) and alone["d"] == ("UNVERIFIABLE", 3, 0.4)


def test_gate_on_literal_cases(spark):
    s, u, v, x, n = "SUPPORTED", "UNSUPPORTED", "UNVERIFIABLE", "UNREACHABLE", "UNCITED"
    cases = {"none": [(n, None, None)], "reject": [(s, 0.9, 0.0), (u, 0.1, 0.78)], "revise": [(s, 0.9, 0.0), (u, 0.1, 0.77)], "gone": [(x, None, None)], "open": [(v, None, None)], "accept": [(s, None, None)] * 3, "half": [(s, 0.75, 0.0), (v, None, None)], "less": [(s, 0.75, 0.0), (v, None, None), (v, None, None)]}
    rows = [(k, *r, None) for k, rs in cases.items() for r in rs]
    res = spark.createDataFrame(rows, "k string, status string, support_score double, contradiction_score double, confidence double")
    got = {r.k: r for r in G.acceptance_gate(res, res, "k").collect()}
    assert {k: (r.decision, r.label) for k, r in got.items()} == {
        "none": ("ABSTAIN", "No citations"), "reject": ("REJECT", "Blocked"), "revise": ("REVISE", "Needs revision"), "gone": ("ABSTAIN", "No evidence"), "open": ("ABSTAIN", "Insufficient evidence"), "accept": ("ACCEPT", "Accepted"),
        "half": ("ACCEPT", "Accepted"), "less": ("REVISE", "Borderline"),
    }
    assert got["gone"].failure_modes == ["No sources could be retrieved", "1 source could not be retrieved"] and got["accept"].summary == "3 of 3 citations verified against sources (88% confidence)."


def test_answers(spark):
    answer = "The old harbor is open during the long winter months [1]. Nobody knows what this other thing could be [2]. Short [3]."
    answers = spark.createDataFrame([(1, answer, ["https://a.org", "https://b.org", "https://c.org"]), (2, "", [])], "answer_id int, answer string, citations array<string>")
    pages = spark.createDataFrame([("https://a.org", PAIRS[1][2] + " " + "More words follow about the harbor. " * 4, None), ("https://b.org", None, None)], "url string, page string, search string")
    results, gates = G.verify_answers(answers, pages, disabled=("EVIDENCE_COVERAGE",))
    got = {r["index"]: r for r in results.collect()}
    assert {i: r.status for i, r in got.items()} == {0: "SUPPORTED", 1: "UNREACHABLE", 2: "UNCITED"}
    assert "EVIDENCE_COVERAGE" not in [s.name for s in got[0].signals] and got[0].tier == 1
    assert {r.answer_id: r.decision for r in gates.collect()} == {1: "ACCEPT", 2: "ABSTAIN"}
    many = spark.createDataFrame([(3, " ".join(f"A claim of some length stands here number {i} [{i}]." for i in range(1, 15)), [f"u{i}" for i in range(14)])], "answer_id int, answer string, citations array<string>")
    assert [r.status for r in G.citations(many).orderBy("index").collect()] == [None] * 12 + ["UNVERIFIABLE"] * 2


def test_claim_graph(spark):
    df = spark.createDataFrame([("x", "Paris was visited by 500 people in the Summer", "Paris was visited by 300 people in the summer of that year.", None)], "id string, claim string, evidence string, url string")
    g = G.claim_graph(df).first()
    kinds = {n.id: n for n in g.nodes}
    assert kinds["entity:paris"].score == 1.0 and kinds["quantity:500"].score == 0.2 and kinds["gate:0"].label == g.gate.decision == "REJECT"
    assert ("quantity:500", "evidence:0", "contradicts") in {(e.source, e.target, e.kind) for e in g.edges}
    keys = [(e.source, e.target, e.kind) for e in g.edges]
    assert len(keys) == len(set(keys)) and len(kinds) == len(g.nodes)


def test_comparison(spark):
    r = G.comparison(spark.createDataFrame([(529, 103, 19)], "unsupported int, rejected int, false_accepts int")).first()
    assert r.abstained == 407 and abs(r.far_of_all - 19 / 529) < 1e-12 and abs(r.far_of_decided - 19 / 122) < 1e-12


def test_claims_read_only_their_own_text_and_window(spark):
    text = "The harbor festival\u00a0 attracted 500 visitors last summer. " + "Boats of many  kinds came to the old harbor in June. " * 30
    claims = spark.createDataFrame([("a", 1, "The harbor festival attracted 500 visitors"), ("b", 2, "Boats came to the harbor"), ("c", 3, None)], "id string, of int, claim string")
    sources = spark.createDataFrame([(1, text), (2, "Menu  of\tthe day")], "of int, evidence string")
    out = R.run_against(claims, sources, "of")
    got = {r.id: r for r in out.collect()}
    assert got["a"].signals[0].evidence == spark.createDataFrame([(text,)], "t string").select(W.clip(F.substring("t", 1, 2000), 180).alias("c")).first().c and len(got["a"].signals[0].evidence) <= 183
    assert got["b"].signals[0].evidence == "Menu of the day" and got["c"].signals[0].evidence == ""
    assert got["a"].windows[0].text == "The harbor festival attracted 500 visitors last summer. Boats of many kinds came to the old harbor in June."
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert above.count(f", {W.SPACE}+, ") == 1  # white space is made single once a source; here only for a source without sentences


def test_sums_of_signals_do_not_depend_on_order(spark):
    from claimloom.operators.evaluate import exact_sum

    rows = spark.createDataFrame([(i, 0.0005 if i % 2 else 1e6 / (3 if i % 4 else -3)) for i in range(4000)] + [(4000, 0.0005)], "i int, x double")
    sums = [rows.orderBy(*by).coalesce(1).agg(exact_sum(F.col("x"), 3).alias("s")).first().s for by in (["i"], [F.desc("i")], [F.hash("i")])]
    assert sums == [1.001] * 3  # 2001 times 0.0005, a half, which goes up
