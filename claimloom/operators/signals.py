"""Detector rules: each is a column of a nullable signal struct. A registry holds them, so callers can add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import text as T

# Fixed values.
CONTRAST_PAIRS = (("public", "private"), ("increase", "decrease"), ("increased", "decreased"), ("largest", "smallest"), ("highest", "lowest"), ("first", "last"), ("before", "after"), ("approved", "rejected"), ("confirmed", "denied"), ("majority", "minority"), ("urban", "rural"), ("domestic", "international"), ("fictional", "real"))
NEGATIONS = ("not", "no", "never", "without", "cannot", "cant", "couldnt", "wouldnt", "isnt", "arent", "doesnt", "dont")
STRONG_HEDGES = ("always", "never", "all", "none", "every", "completely", "definitely", "exclusively", "only")
WEAK_HEDGES = ("sometimes", "often", "usually", "may", "might", "can", "some", "many", "approximately", "roughly")


LABELS = {
    "SOURCE_RETRIEVAL": "Source retrieval", "LEXICAL_OVERLAP": "Claim/source overlap", "EVIDENCE_COVERAGE": "Evidence coverage", "NUMERIC_CONTRADICTION": "Number/date mismatch",
    "CONTRAST_CONTRADICTION": "Semantic contrast", "NEGATION_CONTRADICTION": "Negation mismatch", "ENTITY_SUBSTITUTION": "Entity substitution", "HEDGING_MISMATCH": "Certainty mismatch",
    "QUOTE_MATCH": "Quoted text", "RELATION_CONTRADICTION": "Relation mismatch", "TYPE_CONTRADICTION": "Type mismatch", "EMBEDDING_ALIGNMENT": "Embedding alignment", "NLI_MODEL": "NLI model", "LLM_JUDGE": "LLM judge",
}


def signal(name: str, verdict: Column | str, score: Column | float, weight: Column | float, rationale: Column | str, evidence: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return F.struct(
        F.lit(name).alias("name"), F.lit(LABELS.get(name, name)).alias("label"), lit(verdict).alias("verdict"), lit(score).cast("double").alias("score"), lit(weight).alias("weight"),
        lit(rationale).alias("rationale"), (F.col("primary") if evidence is None else evidence).alias("evidence"),
    )


def source_retrieval() -> Column:
    n = F.col("evidence_length")
    return signal("SOURCE_RETRIEVAL", F.when(n > 200, "NEUTRAL").otherwise("INSUFFICIENT"), F.least(n / 2000, F.lit(1.0)), 0.08, F.when(n > 200, "Readable source text was retrieved.").otherwise("The retrieved source text is too short."))


def lexical_overlap() -> Column:
    def of(score: Column) -> Column:
        return signal("LEXICAL_OVERLAP", F.when(score >= 0.6, "SUPPORT").otherwise("NEUTRAL"), score, 0.20, F.when(score >= 0.6, "Most claim n-grams appear in the source.").otherwise("Semantic verification is needed."))

    return T.let(T.ngram_overlap(F.col("claim_tokens"), F.col("evidence_norm")), of)


def evidence_coverage() -> Column:
    c = F.col("coverage")
    said = F.when(c >= 0.65, "A compact evidence window covers most claim terms.").when(c <= 0.18, "No retrieved passage covers enough of the claim.").otherwise("The source has partial topical overlap with the claim.")
    return signal("EVIDENCE_COVERAGE", F.when(c >= 0.65, "SUPPORT").when(c <= 0.18, "INSUFFICIENT").otherwise("NEUTRAL"), c, 0.17, said)


def numeric_contradiction() -> Column:
    mine, theirs = F.col("claim_numbers"), F.col("primary_numbers")
    missing = F.array_except(mine, theirs)
    fires = (F.size(theirs) > 0) & (F.size(missing) > 0) & (F.col("coverage") >= 0.35)
    first3 = lambda x: F.array_join(F.slice(x, 1, 3), ", ")
    return F.when(fires, signal("NUMERIC_CONTRADICTION", "CONTRADICT", 0.88, 0.28, F.concat(F.lit("Claim uses "), first3(missing), F.lit(", but the strongest evidence uses "), first3(theirs), F.lit("."))))


def contrast_contradiction() -> Column:
    """The first pair in declared order decides the rationale."""
    c, e = F.col("claim_norm"), F.col("primary_norm")
    has = lambda a, b: F.contains(c, F.lit(a)) & F.contains(e, F.lit(b)) & ~F.contains(e, F.lit(a))
    hits = [F.when(has(a, b), F.lit(f"Claim says {a}, while evidence says {b}.")) for p in CONTRAST_PAIRS for a, b in (p, p[::-1])]
    said = F.coalesce(*hits)
    return F.when(said.isNotNull(), signal("CONTRAST_CONTRADICTION", "CONTRADICT", 0.82, 0.20, said))


def negation_contradiction() -> Column:
    neg = T.words_array(NEGATIONS)
    fires = (F.arrays_overlap(F.split("claim_norm", " "), neg) != F.arrays_overlap(F.split("primary_norm", " "), neg)) & (F.col("coverage") >= 0.55)
    return F.when(fires, signal("NEGATION_CONTRADICTION", "CONTRADICT", 0.90, 0.30, "Negation appears on only one side of the claim/evidence pair."))


def entity_substitution() -> Column:
    missing = F.filter("claim_entities", lambda x: ~F.contains(F.col("primary_norm"), T.normalize_for_match(x)))
    return F.when((F.size(missing) > 0) & (F.col("coverage") >= 0.45), signal("ENTITY_SUBSTITUTION", "CONTRADICT", 0.72, 0.18, F.concat(F.lit("Entity missing from evidence: "), F.get(missing, F.lit(0)), F.lit("."))))


def hedging_mismatch() -> Column:
    """Of several certain or hedging words the rationale names the first in declared order."""
    strong = F.array_intersect(T.words_array(STRONG_HEDGES), F.split("claim_norm", " "))
    weak = F.array_intersect(T.words_array(WEAK_HEDGES), F.split("primary_norm", " "))
    return F.when((F.size(strong) > 0) & (F.size(weak) > 0), signal("HEDGING_MISMATCH", "CONTRADICT", 0.62, 0.12, F.concat(F.lit("Claim uses strong certainty ("), F.get(strong, F.lit(0)), F.lit("); evidence hedges ("), F.get(weak, F.lit(0)), F.lit(")."))))


RULES: dict[str, Callable[[], Column]] = {
    "SOURCE_RETRIEVAL": source_retrieval, "LEXICAL_OVERLAP": lexical_overlap, "EVIDENCE_COVERAGE": evidence_coverage,
    "NUMERIC_CONTRADICTION": numeric_contradiction, "CONTRAST_CONTRADICTION": contrast_contradiction, "NEGATION_CONTRADICTION": negation_contradiction,
    "ENTITY_SUBSTITUTION": entity_substitution, "HEDGING_MISMATCH": hedging_mismatch,
}
DEFAULT_RULES = ("SOURCE_RETRIEVAL", "LEXICAL_OVERLAP", "EVIDENCE_COVERAGE")
EIGHT_RULES = tuple(RULES)


def support_score(signals: Column) -> Column:
    """Weighted mean of supporting signals, summed in array order."""
    yes = F.filter(signals, lambda s: s["verdict"] == "SUPPORT")
    mass = F.aggregate(yes, F.lit(0.0), lambda a, s: a + s["score"] * s["weight"])
    return mass / F.greatest(F.aggregate(yes, F.lit(0.0), lambda a, s: a + s["weight"]), F.lit(0.01))


def contradiction_score(signals: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(signals, lambda s: s["verdict"] == "CONTRADICT"), lambda s: s["score"])), F.lit(0.0))
