"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, classifier, decontam, language_id, lm_scoring, media, sharding, simhash, suffix_dedup, url_filter

MODULES = (decontam, suffix_dedup, bpe, url_filter, lm_scoring, classifier, media, language_id, simhash, sharding)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
