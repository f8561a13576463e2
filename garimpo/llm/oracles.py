"""DuckDB statements of those pN_ queries that SQL can express."""

from __future__ import annotations

TOKENS = r"len(regexp_extract_all(coalesce({0}, ''), '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+'))"

CHUNKS = "select chunk_id, any_value(text) as text, max(n_tokens) as n_tokens, min(doc_id) as doc_id, max(categoria) as categoria from chunks group by chunk_id"

P1 = r"""
with w as (select chunk_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') as w from chunks where text is not null group by chunk_id),
s as (select distinct chunk_id, unnest([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in generate_series(1, len(w) - 2)]) as s from w where len(w) >= 3),
n as (select chunk_id, count(*) as n from s group by chunk_id),
c as (select a.chunk_id as a, b.chunk_id as b, count(*) as c from s a join s b on a.s = b.s and a.chunk_id < b.chunk_id group by 1, 2)
select a as chunk_id_a, b as chunk_id_b from c join n x on x.chunk_id = a join n y on y.chunk_id = b where c >= 0.7 * (x.n + y.n - c) - 1e-9
"""

P5 = r"""
with m as (select id, min(fonte) as fonte from manifest group by id),
c as (select distinct chunk_id, m.fonte, text from chunks join m on doc_id = id where m.fonte is not null and text is not null),
n as (select fonte, count(distinct chunk_id) as n from c group by fonte),
r as (select fonte, chunk_id, string_split(text, chr(10)) as l from c),
x as (select fonte, chunk_id, unnest(generate_series(1, len(l)))::int as linha_no, unnest(l) as raw from r),
y as (select fonte, chunk_id, linha_no, lower(trim(regexp_replace(regexp_replace(raw, '[0-9]+', '#', 'g'), '[ \t\x{00a0}]+', ' ', 'g'))) as line from x),
q as (select fonte, line from y join n using (fonte) where length(line) >= 15 group by fonte, line, n having count(distinct chunk_id) >= 4 and count(distinct chunk_id) >= 0.03 * n - 1e-9)
select distinct chunk_id, linha_no from y join q using (fonte, line)
"""

P9 = r"""
with d as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from itens_teste where text is not null),
x as (select distinct item_id, unnest([array_to_string(w[k : k + 11], ' ') for k in generate_series(1, len(w) - 11)]) as s from i where len(w) >= 12),
y as (select distinct doc_id, unnest([array_to_string(w[k : k + 11], ' ') for k in generate_series(1, len(w) - 11)]) as s from d where len(w) >= 12)
select distinct doc_id, item_id from y join x using (s)
"""

ORACLES: dict[str, str] = {
    "p1_found": P1,
    "p5_found": P5,
    "p6_found": f"select distinct chunk_id from chunks where {TOKENS.format('text')} > 1024",
    "p7_found": f"select chunk_id from ({CHUNKS}) where {TOKENS.format('text')} > 0 and (n_tokens is null or n_tokens <= 0 or abs(n_tokens - {TOKENS.format('text')}) > 0.2 * {TOKENS.format('text')})",
    "p7_totals": f"""
with m as (select id, min(fonte) as fonte, min(idioma) as idioma from manifest group by id),
c as (select *, {TOKENS.format('text')} as t, replace(lower(trim(categoria)), ' ', '_') as k from ({CHUNKS})),
d as (select *, t > 0 and (n_tokens is null or n_tokens <= 0 or abs(n_tokens - t) > 0.2 * t) as bad from c)
select fonte, idioma, case when k not in ('', '?') then k end as categoria, count(*) as chunks,
  cast(sum(case when bad then t when t = 0 then 0 else n_tokens end) as bigint) as tokens, count(*) filter (bad) as repaired
from d left join m on doc_id = id group by all""",
    "p9_found": P9,
    "p8_found": f"select distinct doc_id from documents where {TOKENS.format('text')} > 2048",
}
