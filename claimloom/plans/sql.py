"""DuckDB expressions equal to the text functions, for the oracle."""

from __future__ import annotations

from claimloom.functions import text as T
from claimloom.operators import signals as S


def strings(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


STOP = strings(T.STOPWORDS)


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{T.SPACE}+', ' ', 'g'))"


def norm(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({t}), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9.\"''%-]+', ' ', 'g'))"


def tokens(t: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({norm(t)}, '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: len(w) > 2 and not list_contains({STOP}, w))"


def sentences(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({collapse(t)}, '{T.SENTENCE}'), lambda s: trim(s)), lambda s: len(s) > 20)"


def unique(items: str) -> str:
    clean = f"list_filter(list_transform({items}, lambda x: {strip('x')}), lambda x: x <> '')"
    return f"list_filter({clean}, lambda x, i: list_position(list_transform({clean}, lambda y: lower(y)), lower(x)) = i)"


def numbers(t: str) -> str:
    return unique(rf"list_transform(regexp_extract_all({t}, '{T.NUMBER}'), lambda x: regexp_replace(replace(x, ',', ''), '%+$', ''))") + "[1:10]"


def entities(t: str) -> str:
    return f"list_filter({unique(f'''regexp_extract_all({t}, '{T.ENTITY}')''')}, lambda e: not list_contains({strings(T.BLOCKED_ENTITIES)}, e))[1:10]"


def relations(t: str) -> str:
    return unique(f"regexp_extract_all({t}, '{T.RELATION}')") + "[1:8]"


def clip(t: str, limit: int = 220) -> str:
    c = collapse(t)
    return f"case when len({c}) <= {limit} then {c} else rtrim(({c})[:{limit - 3}]) || '...' end"


def share(part: str, whole: str) -> str:
    return f"case when len(list_distinct({whole})) > 0 then len(list_intersect(list_distinct({whole}), {part})) / len(list_distinct({whole})) else 0.0 end"


def slug(kind: str, label: str, index: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({label}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:32]"
    return f"'{kind}:' || case when {s} <> '' then {s} else ({index})::varchar end"


#: Every sentence of every document as a claim: the first against its own document, the others against the next one.
PAIRS = f"""
doc as (select doc_id, source, text, {sentences('text')} ss from documents),
pair as (select doc_id, source grp, p - 1 pos, doc_id || ':' || (p - 1) cid, ss[p] claim, case when p = 1 then doc_id else doc_id + 1 end "of" from (select *, unnest(range(1, len(ss) + 1)) p from doc)),
src as (select doc_id "of", text evidence from documents)"""

#: The same for assistant turns of conversations, against the turn before.
TURNS = f"""
said as (select conv_id, turn, {sentences('text')} ss from conversations where role = 'assistant'),
pair as (select conv_id grp, conv_id || ':' || turn || ':' || p cid, ss[p] claim, conv_id || ':' || (turn - 1) "of" from (select *, unnest(range(1, len(ss) + 1)) p from said)),
src as (select conv_id || ':' || turn "of", text evidence from conversations)"""

_any = lambda words, t: f"len(list_intersect(string_split({t}, ' '), {strings(words)})) > 0"
_PAIRS8 = "[" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for p in S.CONTRAST_PAIRS for a, b in (p, p[::-1])) + "]"

VERIFIED = f"""
ev as materialized (select "of", coalesce(evidence, '') evidence, {norm("coalesce(evidence, '')")} en, {numbers("coalesce(evidence, '')")} enums, {sentences("coalesce(evidence, '')")} ess from src),
sets as materialized (select *, list_transform(ess, lambda s: list_distinct({tokens('s')})) es from ev),
tok as materialized (select *, {tokens('claim')} ct, {norm('claim')} cn, {entities('claim')} ents, {numbers('claim')} nums from pair),
win as (select cid, i - 1 "position", c, list_distinct(list_concat(es[i], coalesce(es[i + 1], []))) wt from (select cid, list_distinct(ct) c, es, unnest(range(1, len(es) + 1)) i from tok join sets using ("of") where len(ct) > 0)),
scored as (select cid, "position", h / greatest(n, 1) cov, h / greatest(m, 1) den from (select cid, "position", len(list_intersect(c, wt)) h, len(c) n, len(wt) m from win)),
best as (select *, greatest(0.0, least(1.0, cov * 0.78 + least(den * 3, 1.0) * 0.22)) overlap from scored),
ranked as (select *, row_number() over (partition by cid order by overlap desc, "position") nth from best qualify nth <= 3),
wins as (select cid, list(cov order by nth) covs, list(overlap order by nth) overs, list("position" order by nth) places from ranked group by 1),
seen as (select tok.*, coalesce(evidence, '') evidence, coalesce(en, '') en, coalesce(enums, []) enums, coalesce(ess, []) ess, coalesce(covs, []) covs, coalesce(overs, []) overs, coalesce(places, []) places,
  list_transform(coalesce(places, []), lambda p: {clip("ess[p + 1] || coalesce(' ' || ess[p + 2], '')", 700)}) texts from tok left join sets using ("of") left join wins using (cid)),
first_ as (select *, coalesce(texts[1], evidence[:700]) primary_text from seen),
sig as (select *, {norm('primary_text')} pn, {numbers('primary_text')} pnums, {share(tokens('primary_text'), 'ct')} cover,
  case when len(ct) >= 5 then len(list_filter(range(1, len(ct) - 3), lambda i: contains(en, array_to_string(ct[i:i + 4], ' ')))) / (len(ct) - 4) else 0.0 end lex from first_),
rep as (select *, (case when lex >= 0.6 then lex * 0.20 else 0 end + case when cover >= 0.65 then cover * 0.17 else 0 end) / greatest(case when lex >= 0.6 then 0.20 else 0 end + case when cover >= 0.65 then 0.17 else 0 end, 0.01) rsup,
  list_filter(covs, lambda x: x >= 0.62) gcov, list_filter(ents, lambda e: contains(en, {norm('e')})) fents, list_filter(nums, lambda x: list_contains(enums, x)) fnums from sig),
edge as (select *, list_concat(list_concat(gcov, list_transform(fents, lambda x: 0.9)), list_concat(list_transform(fnums, lambda x: 0.9), list_concat(case when lex >= 0.6 then [lex * 0.20] else [] end, case when cover >= 0.65 then [cover * 0.17] else [] end))) up from rep),
score as (select *, greatest(rsup, coalesce(list_sum(up), 0) / greatest(len(up), 1)) support,
  least(1.0, greatest(case when len(nums) > len(fnums) then 0.78 else 0 end, case when len(ents) > len(fents) then 0.35 * 0.45 else 0 end,
    case when length(evidence) <= 200 then least(length(evidence) / 2000, 1) * 0.08 * 0.45 else 0 end, case when cover <= 0.18 then cover * 0.17 * 0.45 else 0 end)) contradiction, coalesce(covs[1], 0.0) coverage from edge),
verdict as materialized (select *, least(1.0, contradiction + greatest(0.0, 0.55 - coverage) * 0.3) risk, case when contradiction >= 0.78 then 'REJECT' when coverage < 0.18 then 'ABSTAIN' when support >= 0.78 and coverage >= 0.74 and contradiction < 0.25 then 'ACCEPT' else 'REVISE' end decision from score)"""

#: (cid, name, verdict) of all eight rules.
EIGHT = f"""
fired as (
  select cid, 'SOURCE_RETRIEVAL' "name", case when length(evidence) > 200 then 'NEUTRAL' else 'INSUFFICIENT' end verdict from verdict
  union all select cid, 'LEXICAL_OVERLAP', case when lex >= 0.6 then 'SUPPORT' else 'NEUTRAL' end from verdict
  union all select cid, 'EVIDENCE_COVERAGE', case when cover >= 0.65 then 'SUPPORT' when cover <= 0.18 then 'INSUFFICIENT' else 'NEUTRAL' end from verdict
  union all select cid, 'NUMERIC_CONTRADICTION', 'CONTRADICT' from verdict where len(pnums) > 0 and len(list_filter(nums, lambda x: not list_contains(pnums, x))) > 0 and cover >= 0.35
  union all select cid, 'CONTRAST_CONTRADICTION', 'CONTRADICT' from verdict where len(list_filter({_PAIRS8}, lambda x: contains(cn, x.a) and contains(pn, x.b) and not contains(pn, x.a))) > 0
  union all select cid, 'NEGATION_CONTRADICTION', 'CONTRADICT' from verdict where ({_any(S.NEGATIONS, 'cn')}) <> ({_any(S.NEGATIONS, 'pn')}) and cover >= 0.55
  union all select cid, 'ENTITY_SUBSTITUTION', 'CONTRADICT' from verdict where len(list_filter(ents, lambda e: not contains(pn, {norm('e')}))) > 0 and cover >= 0.45
  union all select cid, 'HEDGING_MISMATCH', 'CONTRADICT' from verdict where {_any(S.STRONG_HEDGES, 'cn')} and {_any(S.WEAK_HEDGES, 'pn')})"""

_GATE = "case when count(*) filter (decision = 'REJECT') > 0 then 'REJECT' when count(*) filter (decision in ('ABSTAIN', 'REVISE')) / count(*) > 0.25 then 'ABSTAIN' when count(*) filter (decision = 'ACCEPT') = count(*) then 'ACCEPT' else 'REVISE' end"
GATE = f"gate as (select grp, {_GATE} gate, count(*) claims from verdict group by 1)"

_each = lambda items: f"from (select *, unnest({items}) x, unnest(range(0, len({items}))) i from verdict)"
_PCT = "(round_even(cov * 100, 0)::int)::varchar || '% coverage'"
#: The default rules' edges as (kind, label, weight), and nodes as (cid, ord, kind, id, label, score, detail).
EDGES = f"""
w as (select cid, unnest(covs) cov, unnest(overs) ov, unnest(texts) txt, unnest(range(0, len(covs))) i from verdict),
e as (select *, contains(en, {norm('x')}) found {_each('ents')}), q as (select *, list_contains(enums, x) found {_each('nums')}),
r as (select *, {share(tokens("coalesce(texts[1], evidence[:900])"), tokens('x'))} s {_each(relations('claim'))}),
g as (select cid, 'supports' kind, 'support' label, lex * 0.20 weight from verdict where lex >= 0.6 union all select cid, case when cover >= 0.65 then 'supports' else 'attenuates' end, case when cover >= 0.65 then 'support' else 'insufficient' end, cover * 0.17 from verdict where cover >= 0.65 or cover <= 0.18
  union all select cid, 'attenuates', 'insufficient', least(length(evidence) / 2000, 1) * 0.08 from verdict where length(evidence) <= 200),
edges as (
  select 'cites' kind, 'cites' label, 1.0::double weight from verdict union all select 'routes', 'release control', support from verdict
  union all select 'contains', {_PCT}, ov from w union all select case when cov >= 0.62 then 'grounds' else 'routes' end, 'grounds claim', cov from w
  union all select 'mentions', 'mentions', 0.9 from e union all select case when found then 'grounds' else 'attenuates' end, case when found then 'entity match' else 'entity missing' end, case when found then 0.9 else 0.35 end from e
  union all select 'mentions', 'uses number', 0.9 from q union all select case when found then 'grounds' else 'contradicts' end, case when found then 'number match' else 'number missing' end, case when found then 0.9 else 0.78 end from q
  union all select 'mentions', 'relation', 0.8 from r union all select case when s >= 0.7 then 'grounds' else 'routes' end, 'relation evidence', s from r
  union all select kind, label, weight from g),
nodes as (
  select cid, 0 ord, 'claim' kind, 'claim:0' id, {clip('claim')} label, rsup score, '' detail from verdict union all select cid, 0, 'source', 'source:0', 'source:0', 1, '' from verdict
  union all select cid, i, 'evidence', 'evidence:' || i, 'Evidence window ' || (i + 1), cov, txt from w
  union all select cid, i, 'entity', {slug('entity', 'x', 'i')}, x, case when found then 1 else 0.25 end, '' from e
  union all select cid, i, 'quantity', {slug('quantity', 'x', 'i')}, x, case when found then 1 else 0.2 end, '' from q
  union all select cid, i, 'relation', {slug('relation', 'x', 'i')}, {clip('x', 90)}, s, '' from r
  union all select cid, 0, 'signal', 'signal:source_retrieval:0', 'Source retrieval', least(length(evidence) / 2000, 1), 'The retrieved source text is too short.' from verdict where length(evidence) <= 200
  union all select cid, 1, 'signal', 'signal:lexical_overlap:1', 'Claim/source overlap', lex, 'Most claim n-grams appear in the source.' from verdict where lex >= 0.6
  union all select cid, 2, 'signal', 'signal:evidence_coverage:2', 'Evidence coverage', cover, case when cover >= 0.65 then 'A compact evidence window covers most claim terms.' else 'No retrieved passage covers enough of the claim.' end from verdict where cover >= 0.65 or cover <= 0.18
  union all select cid, 0, 'gate', 'gate:0', 'Gate', support, 'risk=' || printf('%.2f', round_even(contradiction, 2)) from verdict),
node as (select * from nodes qualify row_number() over (partition by cid, id order by ord) = 1)"""
