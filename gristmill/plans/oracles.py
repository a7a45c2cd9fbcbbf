"""DuckDB SQL for the query catalogue."""

from __future__ import annotations

WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def fold(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _screen(source: str, exact: bool = False, extra: str = "", email: bool = True) -> str:
    """CTEs ending in r(line, text, state_hash, decision, reason, dup) over a query with line and text."""
    hashed = "text" if exact else fold("text")
    return f"""
s0 as ({source}),
s1 as (select *, case when {fold("text")} <> '' then sha256(cast(json_object('text', {hashed}) as varchar)) end as state_hash from s0),
s2 as (select *, row_number() over (partition by state_hash order by line) as rn from s1),
r as (select line, text{extra}, state_hash, state_hash is not null and rn > 1 as dup,
  case when state_hash is null then 'invalid_content' when rn > 1 then 'exact_duplicate' when length(text) not between 8 and 32000 then 'content_length_outside_bounds'
       when {"regexp_matches(text, '" + EMAIL + "')" if email else "false"} then 'demo_email_pattern' else 'demo_rules_passed' end as reason from s2),
d as (select *, case reason when 'invalid_content' then 'review' when 'exact_duplicate' then 'reject' when 'content_length_outside_bounds' then 'reject' when 'demo_email_pattern' then 'review' else 'keep' end as decision from r)"""


DOCS = "select doc_id + 1 as line, text, lang, source from documents"
_D = "with " + _screen(DOCS, extra=", lang, source")
SQL: dict[str, str] = {
    "screen_decision_counts": _D + " select decision, reason, count(*) as n from d group by all",
    "screen_decisions": _D + " select line, decision, reason, state_hash from d",
    "screen_decisions_exact": "with " + _screen(DOCS, True) + " select line, decision, reason, state_hash from d",
    "duplicate_groups": _D + " select state_hash, count(*) as n, min(line) as first_line from d where state_hash is not null group by 1 having count(*) > 1",
    "length_bounds": "select doc_id + 1 as line, length(text) as n_chars, length(text) between 8 and 32000 as within from documents",
    "email_review": f"select doc_id + 1 as line from documents where regexp_matches(text, '{EMAIL}')",
    "screen_by_lang": _D + " select lang, decision, count(*) as n from d group by all",
    "screen_by_source": _D + " select source, decision, count(*) as n from d group by all",
    "normalize_text": f"""with s as (select doc_id + 1 as line, text, {fold("text")} as f from documents)
select line, case when f <> '' then 'text' end as layout, case when f <> '' then cast(json_object('text', text) as varchar) end as state,
  case when f <> '' then sha256(cast(json_object('text', f) as varchar)) end as state_hash from s""",
    "layout_precedence": f"""with x as (select doc_id + 1 as line, doc_id % 6 as c, doc_id % 6 = 0 and text is not null and {fold("text")} <> '' as good, text, lang, source from documents)
select line, case when good then 'text' when c in (0, 1, 3) then 'instruction' when c in (2, 4) then 'prompt' end as layout,
  case c when 3 then 'instruction_and_output_required' when 4 then 'prompt_and_response_required' when 5 then 'missing_supported_content' end as error,
  sha256(case when good then text when c < 2 then lang || chr(10) || source when c = 2 then source || chr(10) || lang end) as state_sha256 from x""",
    "preview_fields": "select doc_id + 1 as line, left(text, 800) as text, lang, source from documents order by doc_id limit 8",
    "preview_key_union": """with k as (select doc_id, unnest(case doc_id % 3 when 0 then ['text', 'n_chars'] when 1 then ['text', 'lang'] else ['text', 'source'] end) as key, generate_subscripts([1, 2], 1) as i from documents order by doc_id limit 10),
u as (select key, min(doc_id * 2 + i) as place from k group by 1) select row_number() over (order by place) - 1 as pos, key from u qualify row_number() over (order by place) <= 5""",
}

_TALK = f"""with t as (select conv_id + 1 as line, list(struct_pack(content := text, role := role) order by turn) as m, string_agg(text, chr(10) order by turn) as joined,
  string_agg(role || ': ' || text, chr(10) order by turn) as said, arg_max(text, turn) as answer, arg_max(role, turn) as last_role,
  '{{"messages":[' || string_agg('{{"content":' || cast(to_json(text) as varchar) || ',"role":' || cast(to_json(role) as varchar) || '}}', ',' order by turn) || ']}}' as state,
  '{{"messages":[' || string_agg('{{"content":' || cast(to_json({fold("text")}) as varchar) || ',"role":' || cast(to_json(role) as varchar) || '}}', ',' order by turn) || ']}}' as folded
  from conversations group by conv_id)"""
SQL |= {
    "normalize_messages": _TALK + " select line, 'messages' as layout, state, sha256(folded) as state_hash from t",
    "state_text_lengths": _TALK + " select line, length(joined) as n_chars from t",
    "training_texts": _TALK + f" select line, {strip('said')} as text from t",
    "answer_mask_cut": _TALK + f""", x as (select line, {strip("said")} as f, {strip("answer")} as a, last_role from t)
select line, length(f) as full_chars, case when last_role = 'assistant' and a <> '' and ends_with(f, a) and length(f) > length(a) then length(f) - length(a) end as prompt_chars from x""",
    "screen_messages_decisions": _TALK
    + f""", h as (select line, joined, sha256(folded) as state_hash, row_number() over (partition by folded order by line) as rn from t),
q as (select *, case when rn > 1 then 'exact_duplicate' when length(joined) not between 8 and 32000 then 'content_length_outside_bounds' when regexp_matches(joined, '{EMAIL}') then 'demo_email_pattern' else 'demo_rules_passed' end as reason from h)
select line, case reason when 'exact_duplicate' then 'reject' when 'content_length_outside_bounds' then 'reject' when 'demo_email_pattern' then 'review' else 'keep' end as decision, reason, state_hash from q""",
}


def _pairs(a: str, b: str, layout: str) -> str:
    """Two contents, in alphabetical field order."""
    return f"""with p as (select conv_id * 1000 + turn + 1 as line, role, text as asked, lead(text) over w as answered, lead(role) over w as next from conversations window w as (partition by conv_id order by turn)),
q as (select line, asked, answered, {fold("asked")} as fa, {fold("answered")} as fb from p where role = 'user' and next = 'assistant'),
k as (select *, fa <> '' and fb <> '' as ok from q)
select line, '{layout}' as layout, case when ok then cast(json_object('{a}', asked, '{b}', answered) as varchar) end as state,
  case when ok then sha256(cast(json_object('{a}', fa, '{b}', fb) as varchar)) end as state_hash from k"""


SQL |= {
    "normalize_instruction": _pairs("instruction", "output", "instruction"),
    "normalize_prompt": _pairs("prompt", "response", "prompt"),
    "conversation_pairs": """with p as (select conv_id * 1000 + turn + 1 as line, role, text as asked, lead(text) over w as answered, lead(role) over w as next from conversations window w as (partition by conv_id order by turn))
select line, cast(2 as bigint) as n_turns, asked, answered from p where role = 'user' and next = 'assistant'""",
}

# Gates: choice, its probability and the masses on keep and reject, per dimension.
_GATES = """a as (select doc_id, quality = 1 as good, toxic = 1 as toxic, (70 + doc_id % 30) / 100.0::double as sure from labels),
b as (
  select doc_id, 'quality' as dimension, case when good then 'k' when doc_id % 2 = 0 then 'x' else 'r' end as c, 50 + doc_id % 50 as top, sure, 0.6 as need, 0.2 as cap, false as conf from a
  union all select doc_id, 'privacy', case when toxic then 'x' else 'k' end, 50 + (doc_id * 7) % 50, sure, 0.9, 0.1, true from a
  union all select doc_id, 'trainability', case when good and not toxic then 'k' when good then 'r' else 'x' end, 50 + (doc_id * 3) % 50, sure, 0.7, 0.2, false from a),
e as (select *, (100 - top) * 6 // 10 as second, 100 - top - (100 - top) * 6 // 10 as third from b),
f as (select *, top / 100.0::double as probability, (case when c = 'x' then top else third end) / 100.0::double as reject_probability, (case c when 'k' then top when 'r' then second else third end) / 100.0::double as keep_mass from e),
g as (select *, case when c = 'k' then case when keep_mass < need::double then 'keep_probability_below_threshold' when reject_probability > cap::double then 'reject_probability_above_threshold'
        when conf and sure < 0.85::double then 'confidence_below_threshold' end end as gate from f),
dims as (select doc_id, dimension, sure, probability, reject_probability, gate, case when c = 'x' then 'reject' when c = 'r' or gate is not null then 'review' else 'keep' end as decision from g),
rows_ as (select doc_id, case when bool_or(decision = 'reject') then 'reject' when bool_or(decision = 'review') then 'review' else 'keep' end as decision from dims group by 1)"""
_SCORED = (
    "with "
    + _screen("select doc_id + 1 as line, text from documents")
    + ", "
    + _GATES
    + """,
z as (select d.line, d.dup, d.line - 1 as doc_id, d.reason as local, case when d.reason in ('demo_rules_passed', 'demo_email_pattern') then case when g.doc_id is null then 'invalid_request' else 'scorer_decision' end else d.reason end as reason,
   case when d.reason in ('demo_rules_passed', 'demo_email_pattern') then coalesce(g.decision, 'review') else d.decision end as decision,
   case when d.reason in ('demo_rules_passed', 'demo_email_pattern') and g.doc_id is null then 'invalid_request' when d.reason = 'invalid_content' then 'missing_supported_content' end as error
  from d left join rows_ g on g.doc_id = d.line - 1),
ok as (select * from z where reason = 'scorer_decision')"""
)
SQL |= {
    "gate_decisions": "with " + _GATES + " select doc_id, dimension, decision, gate, probability, reject_probability from dims",
    "gate_row_decisions": "with " + _GATES + " select doc_id, decision from rows_",
    "gate_invalid_answers": "select doc_id, case doc_id % 6 when 0 then 'missing resolved model' when 1 then 'unexpected answer dimensions' when 2 then 'wrong answer type' when 3 then 'unexpected probability options' when 4 then 'invalid probability distribution' else 'invalid selected choice' end as error from labels",
    "gate_score_noul": """with p as (select doc_id, doc_id % 40 as p1, (doc_id * 3) % 50 as p2, (70 + doc_id % 30) / 100.0::double as sure, doc_id % 101 as noul, case when doc_id % 10 = 0 then 40 else 0 end as off from labels),
q as (select *, p1 + 2 * p2 + off as score from p),
v as (select *, case when score > 200 then 'numeric response outside range' when off > 0 then 'inconsistent expected score' end as error, case when score >= 150 then 'keep' when score <= 50 then 'reject' else 'review' end as depth,
   case when noul >= 70 then 'keep' when noul <= 30 then 'reject' else 'review' end as safe from q),
w as (select *, depth = 'keep' and sure < 0.85::double as unsure from v)
select doc_id, error, case when error is null then case when depth = 'reject' or safe = 'reject' then 'reject' when depth = 'review' or unsure or safe = 'review' then 'review' else 'keep' end end as decision,
  case when error is null and unsure then 'confidence_below_threshold' end as gate from w""",
    "thresholds": "with " + _GATES + ", n as (select dimension, count(*) as answers, count(gate) as held_back from dims group by 1) select * from (values ('quality', false, 0.6::double, 0.2::double, null::double), ('privacy', true, 0.9::double, 0.1::double, 0.85::double), ('trainability', false, 0.7::double, 0.2::double, null::double)) t(dimension, use_confidence, min_probability, max_reject_probability, min_confidence) join n using (dimension)",
    "scored_decisions": _SCORED + " select line, decision, reason, error from z",
    "dimension_report": _SCORED + " select dimension, count_if(dims.decision = 'keep') as keep, count_if(dims.decision = 'review') as review, count_if(dims.decision = 'reject') as reject, count(*) as evaluated, round(avg(sure), 6) as mean_confidence, round(avg(probability), 6) as mean_probability from dims join ok using (doc_id) group by 1",
    "gate_histogram": _SCORED + " select dimension, gate, count(*) as n from dims join ok using (doc_id) where gate is not null group by all",
    "usage_totals": _SCORED + " select cast(coalesce(sum(doc_id % 100 + 10), 0) as double) as input_tokens, cast(count(*) * 5 as double) as output_tokens, cast(coalesce(sum((doc_id % 8) * 0.25), 0) as double) as cost from ok",
    "model_histogram": _SCORED + " select 'm' || (doc_id % 3) as model, count(*) as n from ok group by all",
    "training_readiness": _SCORED + """, c as (select count(*) as total, count_if(decision = 'keep') as keep, count_if(decision = 'review') as review, count_if(decision = 'reject') as reject, count_if(dup) as duplicates, count_if(error is not null) as error_count, count_if(error = 'invalid_request') as unevaluated from z)
select *, round(unevaluated / cast(total - duplicates as double), 4) as unevaluated_fraction, round(unevaluated / cast(total - duplicates as double), 4) <= 0.05 as training_ready from c""",
    "first_errors": _SCORED + " select line, error from z where error is not null order by line limit 20",
    "cache_replay": _SCORED + " select count_if(reason = 'scorer_decision') as cache_hits, cast(0 as bigint) as requests, count_if(dup) as duplicates, count_if(decision = 'keep') as keep from z",
}

# Splits
_KEYS = f"""k0 as (select doc_id + 1 as line, {strip("text")} as text, doc_id // 4 as group_id from documents where {fold("text")} <> ''),
k as (select line, text, 'text:' || sha256({fold("text")}) as a, 'group_id:' || sha256(cast(group_id as varchar)) as b from k0)"""
_COMP = f"""with recursive {_KEYS},
adj as (select distinct a, b from k union select distinct b, a from k),
reach(n, l) as (select distinct a, a from adj union select adj.b, reach.l from reach join adj on reach.n = adj.a where reach.l < adj.b),
root as (select n, min(l) as component from reach group by n),
c as (select k.line, k.text, k.a, k.b, root.component from k join root on root.n = k.a)"""


def _split(seed: int, name: str = "sp") -> str:
    return f"""g{seed} as (select component, row_number() over (order by sha256('{seed}:' || component), component) - 1 as rank, count(*) over () as n from (select distinct component from c)),
{name} as (select c.*, case when rank < greatest(1, cast(floor(n * 0.15::double) as bigint)) then 'validation' when rank < greatest(1, cast(floor(n * 0.15::double) as bigint)) * 2 then 'test' else 'train' end as split from c join g{seed} using (component))"""


_SPLIT = _COMP + ", " + _split(42)
_TRAIN = (
    _SPLIT
    + """,
tr as (select line, text, row_number() over (order by line) - 1 as i, count(*) over () as n from sp where split = 'train'),
st as (select cast(i // 4 + 1 as bigint) as step, cast(1 as bigint) as epoch, line, text from tr where i < 80)"""
)


def _tokens(source: str, keep: str) -> str:
    """pos, prev, token of rows with text."""
    return f"""(select {keep}, pos, case when pos = 1 then 257 else ids[pos - 1] end as prev, ids[pos] as token from (
  select {keep}, ids, unnest(range(1, len(ids) + 1)) as pos from (
    select {keep}, list_append(list_transform(regexp_extract_all(substr(hex(encode(text)), 1, 512), '..'), lambda h: cast('0x' || h as bigint)), 256) as ids from {source})))"""


_MODEL = _TRAIN + f""", tk as {_tokens("st", "step, line")},
mo as (select prev, token, count(*) as n from tk group by 1, 2), tot as (select prev, cast(sum(n) as bigint) as total from mo group by 1)"""


def _evaluate(source: str, by: str, trained: bool) -> str:
    keep = by or "1 as one"
    loss = "-ln((coalesce(n, 0) + 0.5) / (coalesce(total, 0) + 128.5))" if trained else "-ln(0.5 / 128.5)"
    joins = "left join mo using (prev, token) left join tot using (prev)" if trained else ""
    return f"""{by + "," if by else ""} count(*) as tokens, avg({loss}) as loss from {_tokens(source, keep)} {joins} {"group by " + by if by else ""}"""


SQL |= {
    "split_keys": f"with {_KEYS} select line, cast(0 as bigint) as pos, a as key from k union all select line, 1, b from k",
    "components": _COMP + " select line, component from c",
    "component_sizes": _COMP + " select component, count(*) as n from c group by 1",
    "split_assignment": _SPLIT + " select line, component, split from sp",
    "split_counts": _SPLIT + " select split, count(*) as records, count(distinct component) as groups from sp group by 1",
    "split_leakage": _SPLIT + ", u as (select split, a as key from sp union select split, b from sp) select count(*) as leaks from (select key from u group by 1 having count(*) > 1)",
    "split_seed_sensitivity": _SPLIT + ", " + _split(23, "sq") + " select cast(42 as bigint) as seed, split, count(*) as n, min(line) as first_line from sp group by split union all select 23, split, count(*), min(line) from sq group by split",
    "batch_steps": _TRAIN + " select step, epoch, line from st",
    "byte_token_sums": f"with {_KEYS}, t as {_tokens('k', 'line')} select line, count(*) as n_tokens, cast(sum(token) as bigint) as total from t group by 1",
    "bigram_model": _MODEL + " select cast(prev as bigint) as prev, cast(token as bigint) as token, n from mo",
    "context_totals": _MODEL + " select cast(prev as bigint) as prev, total from tot",
    "loss_history": _MODEL + """, pq as (select step, row_number() over (partition by prev, token order by line, pos) - 1 as c, row_number() over (partition by prev order by line, pos) - 1 as t from tk)
select step, round(avg(-ln((c + 0.5) / (t + 128.5))), 6) as loss from pq group by 1""",
    "loss_history_long": _TRAIN[: _TRAIN.index(",\nst as")] + f""",
vs as (select line, text, epoch, (epoch - 1) * ((n + 1) // 2) + i // 2 + 1 as step from tr, (select unnest([1, 2]) as epoch)),
tk as {_tokens("(select * from vs where step <= 10000)", "step, epoch, line")},
pq as (select step, epoch, row_number() over (partition by prev, token order by step, line, pos) - 1 as c, row_number() over (partition by prev order by step, line, pos) - 1 as t from tk)
select cast(step as bigint) as step, cast(epoch as bigint) as epoch, round(avg(-ln((c + 0.5) / (t + 128.5))), 6) as loss from pq group by 1, 2""",
    "baseline_eval": _TRAIN + ", held as (select split, text from sp where split <> 'train') select split, tokens, round(loss, 6) as loss from (select " + _evaluate("held", "split", False) + ")",
    "heldout_eval": _MODEL + ", held as (select split, text from sp where split <> 'train') select split, tokens, round(loss, 6) as loss, round(exp(loss), 4) as perplexity from (select " + _evaluate("held", "split", True) + ")",
    "external_eval": _MODEL + " select tokens, round(loss, 6) as loss from (select " + _evaluate("benchmark", "", True) + ")",
    "lr_schedule": _TRAIN[: _TRAIN.index(",\nst as")] + """, m as (select least(10000, 2 * ((count(*) + 1) // 2)) as n from tr), w as (select n, greatest(1, n // 10) as w from m)
select s as step, round(case when s < w then (s + 1) / w else greatest(0.0, (n - s) / greatest(1, n - w)) end * cast(0.0002 as double), 12) as rate from (select n, w, unnest(range(n)) as s from w)""",
    "synthetic_corpus": "select 'keep' as decision, count(*) as n, count(distinct doc_id // 2) as groups from documents",
    "jsonl_to_decisions": "with " + _screen("select row_number() over (order by doc_id) as line, text from documents") + " select line, decision, reason, state_hash from d",
    "strict_csv_scan": "with " + _screen("select row_number() over (order by doc_id) as line, text from documents") + " select decision, count(*) as n from d group by 1",
    "strict_jsonl_scan": """with x as (select row_number() over (order by doc_id) as line, doc_id % 50 as c from documents)
select case when c in (7, 11, 13) then 'invalid_json' when c = 9 then 'record_must_be_object' else 'none' end as error, count(*) as n, min(line) as first_line from x group by 1""",
    "recent_runs": "select source as id, max(doc_id) as seq, arg_max(lang, doc_id) as body from documents group by 1 order by seq desc limit 2 offset 2",
    "last_log_entries": "select conv_id, turn, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2",
    "training_text_faults": """select doc_id + 1 as line, case when doc_id % 10 = 1 or text is null or text = '' then 'the training text is empty'
  when doc_id % 500 = 7 and doc_id % 3 > 0 then 'the training text has more than 1000000 characters' when doc_id % 500 <> 7 and length(text) > 1000000 then 'the training text has more than 1000000 characters' end as fault from documents""",
    "split_id_faults": """select row_number() over (order by doc_id) as line, case doc_id % 7 when 0 then '5' when 1 then 'five' end as group_id,
  case when doc_id % 7 >= 3 then 'group_id must be a string or an integer' end as fault from documents""",
    "decision_shares": _D + " select count(*) as records, round(100.0 * count_if(decision = 'keep') / count(*), 2) as keep, round(100.0 * count_if(decision = 'review') / count(*), 2) as review, round(100.0 * count_if(decision = 'reject') / count(*), 2) as reject from d",
    "masking_counters": _TALK + f""", x as (select {strip("said")} as f, {strip("answer")} as a, last_role from t),
m as (select length(f) as n, case when last_role = 'assistant' and a <> '' and ends_with(f, a) and length(f) > length(a) then length(f) - length(a) end as p from x)
select count(p) as masked_rows, cast(sum(coalesce(p, 0)) as bigint) as prompt_chars, cast(sum(n - coalesce(p, 0)) as bigint) as learned_chars from m""",
    "strict_csv_faults": """with d as (select doc_id, doc_id % 20 as c, text, lang, case when doc_id % 20 = 5 then 1 else 1 + length(text) - length(replace(text, chr(10), '')) end as n from documents where text is not null),
p as (select *, 2 + cast(coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as line from d)
select line, case when c = 3 then 'csv_column_count_mismatch' else 'none' end as error, false as input_fatal, case when c <> 3 then sha256(text) end as text_sha256 from p where c <> 5
union all select cast(2 + sum(n) as bigint), 'invalid_csv_syntax', true, null from p""",
}
_LINES = """with x as (select row_number() over (order by doc_id) as line, doc_id, doc_id % 50 as c from documents where text is not null),
f as (select line, doc_id, case when doc_id % 1000 = 3 then 'row_exceeds_1_mib' when c = 5 then 'invalid_utf8' when c in (7, 13, 15) then 'invalid_json' when c = 9 then 'record_must_be_object' else 'none' end as error, c from x where c <> 11 or doc_id % 1000 = 3)"""
SQL["strict_jsonl_faults"] = _LINES + " select line, error, false as input_fatal, case when error = 'none' and c <> 17 then cast(doc_id as varchar) end as group_id from f"
_ARRIVED = _LINES.replace("(order by doc_id) as line, doc_id,", "(partition by doc_id % 5 order by doc_id) as line, doc_id, text,").replace("select line, doc_id, case", "select line, doc_id, text, case")
SQL["stream_file_records"] = _ARRIVED + " select doc_id % 5 as part, line, error, case when error = 'none' and c <> 17 then cast(doc_id as varchar) end as group_id from f"
SQL["stream_file_decisions"] = _ARRIVED + ", " + _screen("select doc_id as line, case when c = 17 then 'the last of two keys counts' else text end as text from f where error = 'none'") + """
select decision, reason, count(*) as n, count(distinct line) as lines, count(distinct state_hash) as states
from (select line, decision, reason, state_hash from d union all select doc_id, 'review', error, null from f where error <> 'none') group by all"""
SQL["dataset_inspection"] = _LINES + " select count(*) as rows, count_if(error <> 'none') as invalid_rows, arg_min(error, line) filter (where error in ('row_exceeds_1_mib', 'invalid_utf8')) as fault from f"
_PLAIN_CUT = f"""p0 as (select line, {strip("said")} as f, {strip("answer")} as a, last_role from t),
p as (select line, f, case when last_role = 'assistant' and a <> '' and ends_with(f, a) and length(f) > length(a) then left(f, length(f) - length(a)) end as q from p0)"""
_CHOSEN = """z as (select line, coalesce(ok, false) as templated, case when ok then full_text else f end as x, case when ok then prompt_text else q end as y from c join p using (line))
select line, templated, sha256(x) as full_sha256, sha256(y) as prompt_sha256, length(x) as full_chars, length(y) as prompt_chars from z"""
_SAID = f"""w as (select conv_id + 1 as line, turn, role, text, {strip("text")} as s, row_number() over (partition by conv_id order by turn) as i, row_number() over (partition by conv_id order by turn desc) as j, first_value(role) over (partition by conv_id order by turn) = 'system' as told,
  first_value(text) over (partition by conv_id order by turn) as one from conversations)"""
SQL["chat_template_marked"] = _TALK + f""", {_PLAIN_CUT}, {_SAID},
r as (select *, case when i = 1 and role <> 'system' then '<|im_start|>system' || chr(10) || 'Answer briefly.<|im_end|>' || chr(10) else '' end || '<|im_start|>' || role || chr(10) || s || '<|im_end|>' || chr(10) as x from w),
c as (select line, string_agg(x, '' order by turn) as full_text, coalesce(string_agg(x, '' order by turn) filter (where j > 1), '') || '<|im_start|>assistant' || chr(10) as prompt_text, arg_max(role, turn) = 'assistant' and starts_with(full_text, prompt_text) as ok from r group by line), """ + _CHOSEN
SQL["chat_template_alternating"] = _TALK + f""", {_PLAIN_CUT}, {_SAID},
v as (select *, i - 1 - told::int as n from w),
r as (select *, case when n < 0 then '' when role = 'user' then '[INST] ' || case when n = 0 and told then one || chr(10) || chr(10) else '' end || s || ' [/INST]' else ' ' || s || '</s>' end as x,
  n < 0 or (role in ('user', 'assistant') and (role = 'user') = (n % 2 = 0)) as fine from v),
c as (select line, '<s>' || string_agg(x, '' order by turn) as full_text, '<s>' || coalesce(string_agg(x, '' order by turn) filter (where j > 1), '') as prompt_text, bool_and(fine) and arg_max(role, turn) = 'assistant' as ok from r group by line), """ + _CHOSEN
SQL["stream_screen"] = _D + " select line, state_hash, decision, reason from d"
SQL["decision_files"] = _D + " select decision, sha256(text) as text_sha256 from d"
SQL["audit_rows"] = _D + " select line, state_hash, 'demo_rule_based' as mode, false as cache_hit, decision, reason from d"
SQL["stored_decisions"] = _D + " select state_hash, decision, reason from d where reason in ('demo_rules_passed', 'demo_email_pattern')"
_KEPT = f"""with recursive {_screen("select doc_id + 1 as line, text from documents")},
k0 as (select line, {strip("text")} as text, (line - 1) // 4 as group_id from d where decision = 'keep'),
k as (select line, text, 'text:' || sha256({fold("text")}) as a, 'group_id:' || sha256(cast(group_id as varchar)) as b from k0)""" + _COMP[_COMP.index(",\nadj as"):]
_KEPT_SPLIT = _KEPT + ", " + _split(42)
SQL["split_files"] = _KEPT_SPLIT + " select split, component, sha256(text) as text_sha256 from sp"
SQL["model_artifact"] = _KEPT_SPLIT + _MODEL[len(_SPLIT):] + " select cast(prev as bigint) as prev, cast(token as bigint) as token, n from mo"


#: The default budget of requests. A fixed value.
BUDGET = 1000
SQL["budgeted_decisions"] = _D + f""",
o as (select line, length(text) % 5 = 0 as bad, row_number() over (order by line) as r, count(*) over () as m from d where reason in ('demo_rules_passed', 'demo_email_pattern')),
k as (select *, sum(bad::int) over (order by line) as k from o),
z as (select line, case when r > {BUDGET} or (bad and m + k > {BUDGET}) then 'request_budget_exhausted' when bad then 'invalid_response' else 'scorer_decision' end as reason,
        case when r > {BUDGET} then 0 when bad and m + k <= {BUDGET} then 2 else 1 end as requests from k)
select line, case z.reason when 'scorer_decision' then 'keep' else coalesce(case when z.reason is not null then 'review' end, d.decision) end as decision, coalesce(z.reason, d.reason) as reason, coalesce(requests, 0)::bigint as requests from d left join z using (line)"""


_EVEN = _screen("select doc_id + 1 as line, text from documents where doc_id % 2 = 0")
SQL["stream_cache_replay"] = f"""with known as (with {_EVEN} select distinct state_hash from d where reason in ('demo_rules_passed', 'demo_email_pattern')),
a as ({_D} select line, decision, reason, state_hash from d)
select line, decision, reason, reason in ('demo_rules_passed', 'demo_email_pattern') and state_hash in (select state_hash from known) as cache_hit from a"""
