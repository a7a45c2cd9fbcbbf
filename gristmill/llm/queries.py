"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.substring_dedup import remove_repeated_spans

    return remove_repeated_spans(table(spark, sf_dir, "documents"))


@query
def op10_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_tree_merge_dedup"] = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""


@query
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gristmill.llm.packing import pack

    path = public_tokenizers.path
    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op6_risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


ORACLES["op1_warc_reassembly"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest, min(page_id) over (partition by body) as head from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and head <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and head <> page_id then head end as refers_to
from d
"""


@query
def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.mixing import mix_counts

    return mix_counts(table(spark, sf_dir, "documents"), budget_share=1.0, entropy_share=0.5, max_repeat=4.0)


ORACLES["op2_temperature_mixing"] = r"""
with recursive sized as (
  select doc_id, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from documents),
src as (select source, cast(sum(n_tokens) as bigint) as tokens from sized group by 1),
tot as (select cast(sum(tokens) as bigint) as total, count_if(tokens > 0) as k from src),
sh as (select source, tokens, tokens / cast(total as double) as p from src, tot where tokens > 0),
goal as (select (-sum(p * ln(p))) + 0.5 * (ln(count(*)) - (-sum(p * ln(p)))) as target, min(p) as least from sh),
bis(n, lo, hi) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select n + 1, case when ok then lo else mid end, case when ok then mid else hi end
  from (select n, lo, hi, (lo + hi) / 2 as mid,
          (select ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2)) from sh) <= (select target from goal) + 1e-12
          and (select (select least from goal) ** ((lo + hi) / 2 - 1) / sum(p ** ((lo + hi) / 2)) from sh) <= 4.0 + 1e-12 as ok
        from bis where n < 40)),
ex as (select case when k <= 1 then 1.0 else (select round(hi, 6) from bis order by n desc limit 1) end as e from tot),
pw as (select s.source, s.tokens, case when s.tokens > 0 then (s.tokens / cast(greatest(total, 1) as double)) ** e else 0 end as power, total from src s, tot, ex),
qt as (select source, tokens, cast(floor(power / (select sum(power) from pw) * total + 0.5) as bigint) as quota from pw),
pl as (select source, tokens, quota, case when tokens > 0 then cast(floor(quota / tokens) as bigint) else 0 end as passes,
         cast(greatest(1, least(4096, ceil(tokens / 65536.0))) as bigint) as n_blocks from qt),
lo as (select d.source, d.doc_id, p.n_blocks + row_number() over (partition by d.source order by sum(n_tokens) desc, md5('mix/' || d.doc_id), d.doc_id) - 1 as own
       from sized d join pl p using (source) where n_tokens > greatest(65536, ceil(p.tokens / 4096.0)) group by d.source, d.doc_id, p.n_blocks),
me as (select d.doc_id, d.source, d.n_tokens, p.passes, p.quota - p.passes * p.tokens as rest, md5('mix/' || d.doc_id) as h, own is not null as single,
         coalesce(own, cast('0x' || substr(md5('mix/' || d.doc_id), 1, 8) as bigint) % p.n_blocks) as block from sized d join pl p using (source) left join lo using (source, doc_id)),
bl as (select source, block, single, passes, rest, sum(n_tokens) as tokens from me group by 1, 2, 3, 4, 5),
tu as (select *, row_number() over (partition by source order by single desc, case when single then block end, md5('mix/' || source || '/' || passes || '/' || block), block) - 1 as turn from bl),
fi(source, turn, room, once) as (
  select distinct source, cast(-1 as bigint), cast(rest as hugeint), 0 from tu
  union all
  select f.source, t.turn, case when t.tokens <= f.room then f.room - t.tokens else f.room end, case when t.tokens <= f.room then 1 else 0 end
  from fi f join tu t on t.source = f.source and t.turn = f.turn + 1),
ro as (select source, arg_max(room, turn) as room from fi group by 1),
cu as (select t.*, f.once from tu t join fi f using (source, turn)),
eb as (select source, arg_min(block, turn) as block from cu where once = 0 and not single group by 1),
un as (select m.source, m.doc_id, m.h, room, sum(m.n_tokens) as tokens from me m join eb using (source, block) join ro using (source) where room > 0 group by 1, 2, 3, 4),
ed as (select source, doc_id from (select *, sum(tokens) over (partition by source order by tokens, h, doc_id) as s from un) where s <= room)
select m.doc_id, m.source, n_tokens, cast(c.passes + c.once + case when ed.doc_id is not null then 1 else 0 end as bigint) as copies, m.block, c.turn
from me m join cu c using (source, block) left join ed on ed.source = m.source and ed.doc_id = m.doc_id
"""


@query
def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gristmill.llm.line_spread import remove_spread_lines

    out = remove_spread_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op4_line_spread"] = r"""
with l as (
  select doc_id, coalesce(source, '') as site, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
t as (select *, trim(line, E' \t\r\x0b\x0c') as body from l),
w as (select body from t where body <> '' group by 1 having count(distinct site) >= 5),
m as (select t.*, w.body is not null as gone from t left join w using (body))
select doc_id, count_if(body <> '') as n_lines, count_if(gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: 50 to a folder, 20 folders to a project; the first of each is its LICENSE."""
    from pyspark.sql import functions as F

    from gristmill.llm.licenses import license_of_files

    i = F.col("doc_id")
    project, folder = F.floor(i / 1000).cast("string"), F.floor(i / 50).cast("string")
    name = F.when(i % 50 == 0, "LICENSE").otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.when(i % 1000 == 0, F.concat_ws("/", F.lit("corpus"), project, F.lit("LICENSE"))).otherwise(F.concat_ws("/", F.lit("corpus"), project, folder, name))
    return license_of_files(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


ORACLES["op3_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
g as (select doc_id, i, w[i] as word, case when i + 49 <= len(w) then md5(array_to_string(w[i:i + 49], ' ')) end as h from p),
m as (select *, h is not null and min(doc_id) over (partition by h) < doc_id as hit from g),
c as (select doc_id, i, word, max(case when hit then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row) = 1 as gone from m),
k as (select doc_id, count(*) as n_words, count_if(gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from c group by 1)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

ORACLES["op5_minhash_near_dedup"] = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
x as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
adj as (select a, b from l union select b, a from l),
reach(n, r) as (select distinct a, a from adj union select adj.b, reach.r from reach join adj on reach.n = adj.a where reach.r < adj.b),
root as (select n as doc_id, min(r) as r from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(root.r, d.doc_id)) as component_id, least(d.doc_id, coalesce(root.r, d.doc_id)) = d.doc_id as kept
from d left join n using (doc_id) left join root using (doc_id)
"""


def _rules_sql() -> str:
    """Statistics, labelled counts and exact binomial tests of the quality rules."""
    from gristmill.llm.quality_rules import GRIDS, LEVEL, LIMIT

    grid = ", ".join(f"('{name}', {i}, {c}::double)" for name, (*_, cuts) in GRIDS.items() for i, c in enumerate(cuts))
    stats = " union all ".join(f"select doc_id, lang, '{name}' as rule, cast({a} as double) / greatest({b}, 1) as stat from c" for name, (a, b, _) in GRIDS.items())
    return rf"""
with t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
ln_ as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
g as (select doc_id, i, w[i] as word, case when i + 2 <= len(w) then array_to_string(w[i:i + 2], ' ') end as h from p),
r as (select *, h is not null and count(*) over (partition by doc_id, h) > 1 as twice from g),
v as (select doc_id, word, max(case when twice then 1 else 0 end) over (partition by doc_id order by i rows between 2 preceding and current row) as covered from r),
wc as (select doc_id, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars, cast(sum(covered) as bigint) as n_repeat_words from v group by 1),
c as (select doc_id, lang, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
   coalesce(n_repeat_words, 0) as n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) as n_upper, coalesce(n_lines, 0) as n_lines,
   coalesce(n_words, 0) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) as base_failed from t left join wc using (doc_id) left join ln_ using (doc_id)),
st as ({stats}),
good as (select c.doc_id, c.lang from c join (select doc_id from labels group by 1 having min(quality) = 1) using (doc_id) where not base_failed),
n as (select lang, count(*) as n, count(*) over () as strata from good group by 1),
grid(rule, idx, cut) as (values {grid}),
e as (select lang, idx, count(distinct doc_id) filter (stat >= cut) as errors from good join st using (doc_id, lang) join grid using (rule) group by all),
b as (select lang, idx, errors, n, strata, list_sum(list_transform(range(0, cast(errors as bigint) + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({LIMIT}::double) + (n - k) * ln(1 - {LIMIT}::double)))) as tail from e join n using (lang)),
o as (select lang, idx, bool_and(errors < n * {LIMIT}::double and tail <= {LEVEL} / strata) over (partition by lang order by idx) as ok from b),
u as (select lang, max(idx) as idx from o where ok group by 1),
bad as (select doc_id from st join u using (lang) join grid using (rule, idx) where stat >= cut group by 1)
select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept from c left join bad using (doc_id)
"""


ORACLES["op6_risk_thresholds"] = _rules_sql()


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gristmill.llm.periodic_runs import periodic_runs, planted, run_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return run_digests(periodic_runs(docs))


@query
def op12_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


@query
def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gristmill.llm.prefix_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op11_periodic_runs"] = r"""
with bits as (select b, list_reduce(list_prepend(b::bigint, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(b)),
tab as (select list(v order by b) as t from bits),
d as (select doc_id, coalesce(text, '') as text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) as h from documents, tab),
w as (select doc_id, h, h // 10 as g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n from d),
a as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a from w),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
s as (select doc_id, unnest(range(n)) as i, a, p, w from p),
t as (select doc_id, i, w[1 + case when i < a then i else a + (i - a) % p end] as word from s),
e as (select x.doc_id, y.i - x.i as q, x.i from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i),
k as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as isle from e),
m as (select doc_id, q, min(i) as s, count(*) + q as len from k group by doc_id, q, isle having count(*) >= q and count(*) + q >= 12),
r as (select doc_id, s, len, min(q) as q from m group by 1, 2, 3),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(s + q, s + len)) as i from r)),
c as (select t.doc_id, string_agg(word, ' ' order by t.i) as text from t left join gone using (doc_id, i) where gone.i is null group by 1),
b as (select doc_id, count(*) as n_runs, arg_min({'s': s, 'len': len, 'q': q}, {'l': -len, 's': s, 'q': q}) as b, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q)) as runs from r group by 1)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.b.s as start, b.b.len as length, b.b.q as period, 1000 * b.b.len // b.b.q as exponent_milli,
       coalesce(runs, sha256('')) as runs_sha256, sha256(coalesce(c.text, '')) as collapsed_sha256
from d left join b using (doc_id) left join c using (doc_id)
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codebooks by name of round, as long tables of part, entry, component."""
    steps = [
        f"""
v as (select row_number() over (order by vec_id) - 1 as r, vec_id, label, embedding from embeddings where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
f as (select r, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as j, len(embedding) // {parts} as width from v),
x as (select r, j // width as part, j % width as j, cast(floor(1024 * x::double) as bigint) as x from f),
c0 as (select part, r as entry, j, x from x where r < {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} as (select x.r, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x))::bigint as far from x join c{i} c using (part, j) group by 1, 2, 3)")
        steps.append(f"a{i} as (select r, part, arg_min(entry, (far, entry)) as entry, min(far) as far from d{i} group by 1, 2)")
        if i < rounds:
            steps.append(f"m{i} as (select a.part, a.entry, x.j, cast(floor(sum(x.x) / count(*)) as bigint) as x from a{i} a join x using (r, part) group by 1, 2, 3)")
            steps.append(f"c{i + 1} as (select part, entry, j, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (part, entry, j))")
    return f"""with {", ".join(steps)},
book as (select sha256(string_agg(x::varchar, ',' order by part, entry, j)) as h from c{rounds}),
o as (select r, string_agg(lower(printf('%02x', entry)), '' order by part) as code, sum(far)::bigint as error from a{rounds} group by 1)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from v join o using (r), book"""


ORACLES["op12_va_codes"] = _codes_sql()
