"""URL, page and answer functions of the web profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_page(t: Column) -> Column:
    """Markdown links become their text, bare URLs go, runs of three and more newlines become two."""
    t = F.regexp_replace(t, r"\[([^\]]*)\]\(https?://[^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), r"\n{3,}", "\n\n")


def assemble(url: Column, page: Column, search: Column) -> Column:
    """Source text of a page of over 80 characters (cut at 5000) and of search results; null if neither is there."""
    page = F.when(F.length(F.trim(page)) > 80, F.concat(F.lit("--- SOURCE ("), url, F.lit(") ---\n"), F.substring(page, 1, 5000)))
    search = F.when(F.length(search) > 0, F.concat(F.lit("--- WEB SEARCH ---\n"), search))
    return F.nullif(F.concat_ws("\n\n", page, search), F.lit(""))


def routed(url: Column, encyclopedia: Column, reader: Column, academic: Column, search: Column) -> Column:
    """struct<page, search>: which fetched text is the page and which backs it, by the kind of site; null texts were not found.

    Sites that cannot be read have search results (of papers for academic ones) alone; encyclopedia pages of over 200
    characters stand alone; academic pages of over 200 are backed by the paper's text, else it is the page; others need 100.
    """
    from . import web_text as W

    backing = F.coalesce(search, academic)
    pair = lambda page, back: F.struct(page.cast("string").alias("page"), back.cast("string").alias("search"))
    none = F.lit(None)
    return (
        F.when(W.is_unfetchable(url), pair(none, backing))
        .when(W.is_encyclopedia(url), F.when(F.length(encyclopedia) > 200, pair(encyclopedia, none)).otherwise(pair(reader, backing)))
        .when(W.is_academic(url), F.when(F.length(reader) > 200, pair(reader, academic)).otherwise(pair(academic, none)))
        .otherwise(F.when(F.length(reader) >= 100, pair(reader, backing)).otherwise(pair(none, backing)))
    )


def first_long(*options: tuple[Column, int]) -> Column:
    """The first text of over the length that goes with it: the fallback chain of fetched sources."""
    return F.coalesce(*[F.when(F.length(c) > n, c) for c, n in options])


def align_claims(answer: Column, citations: Column) -> Column:
    """array<string>, one claim per citation: the text before its marker [i], from the last sentence break on, without
    markers and bold marks; null if there is no marker or the text has at most 8 characters. A marker right after another [ is none."""

    def claim(_: Column, i: Column) -> Column:
        mark = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))
        # the first marker that no bracket stands before
        head = F.call_function("regexp_extract", answer, F.concat(F.lit(r"(?s)^(.*?)(?<!\[)\["), (i + 1).cast("string"), F.lit(r"\]")), F.lit(1))
        before = F.when(F.contains(answer, mark), F.regexp_replace(head, r"^\s+|\s+$", ""))
        tail = F.regexp_replace(before, r"(?s)^.*(?:[.!?] |\.\n|\n\n)", "")
        clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"\[\d+\]", ""), r"\*\*", ""), r"^\s+|\s+$", "")
        return F.when(F.length(clean) > 8, clean)

    return F.transform(citations, claim)


def atomic_claims(claim: Column) -> Column:
    """A claim's parts between conjunctions, those of over 15 characters and 3 words that count; the claim itself if it has no conjunction."""
    from . import web_text as W

    parts = F.split(claim, r"(?i)\b(?:and|as well as|in addition to|while also|additionally)\b", -1)
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (F.length(p) > 15) & (F.size(W.tokenize(p)) >= 3))
    return F.when(F.size(parts) <= 1, F.array(F.trim(claim))).otherwise(kept)
