"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = rf"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
w3 as (select doc_id, w, len(w) as n, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 4),
g as (select doc_id, n, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as times from w3),
r as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where times > 1) group by doc_id),
l as (select doc_id, x from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
dl as (select doc_id, count(*)::bigint as n_lines, (count(*) - count(distinct x))::bigint as n_dup_lines from l group by doc_id),
m as (select d.doc_id, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0) as n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as upper_letters,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as letters,
    (length(t) - length(replace(t, '!!', ''))) // 2 as cries
  from d left join r using (doc_id) left join dl using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words
    or 2 * n_dup_lines > greatest(1, n_lines) or 10 * upper_letters > 6 * letters
    or 10 * cries > 3 * greatest(1, n_words) or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from m
"""

OP6 = rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select *, {LOWER.format(f"trim(line, {BLANKS})")} as key from l),
c as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.last as gone from k left join c using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

OP9 = r"""
with recursive d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
s as (select source, sum(n_tokens)::bigint as tokens from d group by source),
p as (select tokens::double / max(tokens) over () as r from s where tokens > 0),
grid as (select k, k / 1024.0 as a from range(0, 1025) g(k)),
z as (select k, a, sum(pow(r, a)) as z, sum(pow(r, a) * ln(r)) as zl, min(r) as low, count(*) as n from grid, p group by k, a),
fit as (select max(k) filter (ln(z) - a * zl / z >= 0.95 * ln(n::double)) as flat, min(k) filter (pow(low, a - 1) <= 2.0) as safe, any_value(n) as n from z),
x as (select (case when n < 2 then 1024 else greatest(coalesce(flat, 0), coalesce(safe, 1024)) end) / 1024.0 as a from fit),
plan as (select source, tokens, case when tokens > 0 then round(pow(tokens::double / max(tokens) over (), a - 1), 6) else 1.0 end as repeats from s, x),
q as (select *, ceil(repeats * tokens)::bigint as quota, greatest(1, ceil(tokens / 1048576.0))::bigint as blocks from plan),
o as (select d.doc_id, d.source, d.n_tokens, q.tokens, q.repeats, q.quota, md5(coalesce(text, '')) as row_key, q.blocks,
    unnest(range(1, greatest(1, ceil(q.repeats)::bigint) + 1)) as epoch from d join q using (source)),
c as (select *, ('0x' || substr(md5('17|' || doc_id || '|' || row_key), 1, 12))::bigint % blocks as block, md5('17|' || epoch || '|' || doc_id || '|' || row_key) as row_order from o),
b as (select source, epoch, block, sum(n_tokens) as tokens_in, md5('17|' || epoch || '|' || source || '|' || block) as block_order from c group by source, epoch, block),
br as (select *, row_number() over w - 1 as block_rank, sum(tokens_in) over w - tokens_in as before from b window w as (partition by source, epoch order by block_order, block)),
cr as (select *, row_number() over w - 1 as row_rank, sum(n_tokens) over w as up_to from c window w as (partition by source, epoch, block order by row_order, doc_id, row_key rows unbounded preceding))
select doc_id, source, n_tokens, epoch, block_rank, row_rank from cr join br using (source, epoch, block)
where epoch <= floor(repeats) or (epoch - 1) * tokens + before + up_to <= quota
"""

ORACLE: dict[str, str] = {"op2_quality_rules": OP2, "op6_line_dedup": OP6, "op9_mixing": OP9}
