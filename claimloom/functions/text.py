"""Text functions over columns. All are native expressions; null text gives null or empty arrays as said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "from", "was", "were", "are", "has", "had", "have", "its", "his", "her", "their", "about", "into", "than", "then", "also", "only", "according", "source", "claim",
    "been", "being", "which", "who", "whom", "where", "when", "what", "how", "does", "did", "but", "can", "will", "would", "could", "should", "may", "might",
)
BLOCKED_ENTITIES = ("The", "This", "That", "There", "Here", "According", "Although", "However")
#: White space of any script, as a character class for Java and RE2 (\s is ASCII in both).
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RELATION = rf"(?i)\b(?:founded|created|directed|written|produced|invented|composed|designed|organized|reviewed){SPACE}+by{SPACE}+([^.;,\n]{{2,70}})"
SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"
ENTITY = rf"\b[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+){{0,3}}"
NUMBER = r"\b\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?\b"


def words_array(items) -> Column:
    return F.array(*map(F.lit, items))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body has it, also in lambdas that run for each item."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def strip(t: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, rf"{SPACE}+", " "))


def normalize(t: Column) -> Column:
    """Lower case; other than ASCII is deleted, the curly apostrophe included."""
    return F.regexp_replace(F.lower(t), r"[^\x00-\x7F]+", "")


def normalize_for_match(t: Column) -> Column:
    return F.trim(F.regexp_replace(normalize(t), r"[^a-z0-9.\"'%-]+", " "))


def _runs(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit("[a-z0-9]{3,}"), F.lit(0))


def tokenize(t: Column) -> Column:
    """Words of over two characters that are no stopwords, repeats kept."""
    return F.filter(_runs(normalize(t)), lambda w: ~w.isin(*STOPWORDS))


def token_set(t: Column) -> Column:
    """The distinct words of tokenize, in order."""
    return F.array_except(_runs(normalize(t)), words_array(STOPWORDS))


def token_sets(texts: Column) -> Column:
    """token_set of each of an array's texts, none of which holds a line break; one pass over all of them."""
    lines = F.split(normalize(F.array_join(texts, "\n")), "\n")
    return F.transform(F.slice(lines, 1, F.size(texts)), lambda s: F.array_except(_runs(s), words_array(STOPWORDS)))


def unique(items: Column) -> Column:
    """Trimmed items, each the first of those equal in any case; empty ones go."""
    clean = F.filter(F.transform(items, strip), lambda x: x != "")
    return let(clean, lambda c: let(F.transform(c, lambda x: F.lower(x)), lambda low: F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def clip(t: Column, limit: int = 220) -> Column:
    return shorten(collapse(t), limit)


def shorten(t: Column, limit: int = 220) -> Column:
    """clip of a text whose white space is single already, as that of sentences is."""
    return let(t, lambda c: F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))))


def split_sentences(t: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(collapse(t), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def extract_entities(t: Column, limit: int = 10) -> Column:
    return F.slice(F.filter(unique(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))), lambda e: ~e.isin(*BLOCKED_ENTITIES)), 1, limit)


def extract_numbers(t: Column, limit: int = 10) -> Column:
    """The first distinct numbers, without commas and percent signs; those after the limit are not seen."""
    raw = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))
    return F.slice(unique(F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), "%+$", ""))), 1, limit)


def extract_relations(t: Column, limit: int = 8) -> Column:
    return F.slice(unique(F.regexp_extract_all(t, F.lit(RELATION), F.lit(0))), 1, limit)


def share(part: Column, whole: Column) -> Column:
    """Distinct items of whole that are in part, over all of them; 0 for none."""
    return let(F.array_distinct(whole), lambda kinds: F.when(F.size(kinds) > 0, F.size(F.array_intersect(kinds, part)) / F.size(kinds)).otherwise(0.0))


def token_coverage(claim: Column, evidence: Column) -> Column:
    return share(token_set(evidence), token_set(claim))


def ngrams(tokens: Column, n: int = 5) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngram_overlap(tokens: Column, normalized_source: Column, n: int = 5) -> Column:
    """Share of the token n-grams that stand in the normalised source as text; 0 for under n tokens."""
    return let(ngrams(tokens, n), lambda grams: F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: F.contains(normalized_source, g))) / F.size(grams)).otherwise(0.0))


def node_id(kind: str, label: Column, index: Column, width: int = 32) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, width)
    return F.concat(F.lit(f"{kind}:"), F.when(slug != "", slug).otherwise(index.cast("string")))


def percent(share: Column) -> Column:
    """A share as a whole number of percent, halves to even, with the sign."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))
