"""DuckDB statements of the core queries that SQL can express."""

from __future__ import annotations

import unicodedata

from garimpo.operators.answer import SYSTEM_RAG

W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
CHUNKS = "(select chunk_id, any_value(doc_id) as doc_id, any_value(titulo) as titulo, any_value(fonte) as fonte, any_value(categoria) as categoria, any_value(subcategoria) as subcategoria, any_value(ano) as ano, any_value(vigencia) as vigencia, any_value(url) as url, any_value(section) as section, any_value(n_tokens) as n_tokens, any_value(text) as text, any_value(embedding) as embedding from chunks where chunk_id is not null group by chunk_id)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, '{LINE_BREAKS}')"
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


def key(x: str) -> str:
    return rf"regexp_replace(lower({strip(rf'''regexp_replace({x}, '\p{{Nd}}+', '#', 'g')''')}), '{W}+', ' ', 'g')"


def filled(x: str) -> str:
    return f"list_filter({x}, lambda l: regexp_matches(l, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]'))"


def blocks(x: str) -> str:
    return filled(rf"string_split_regex({x}, '\n{W}*\n')")


def tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+'))"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def compatibility(x: str) -> str:
    """Compatibility form: the characters of these ranges that have one are replaced, then composed."""
    for c in map(chr, (*range(0xA0, 0xC0), *range(0x2D8, 0x2DE), *range(0x2000, 0x2150))):
        if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c):
            x = f"replace({x}, {quoted(c)}, {quoted(unicodedata.normalize('NFKC', c))})"
    return f"nfc_normalize({x})"


PAGE = rf"'(?i)^{W}*(p[áa]g(?:ina)?\.?{W}*)?\p{{Nd}}{{1,4}}{W}*(/|de|of)?{W}*\p{{Nd}}{{0,4}}{W}*$'"
LISTED = rf"'(?i)^{W}*(\p{{Nd}}+(\.\p{{Nd}}+)*[).\-–]{W}|[a-z][).]{W}|[•\-–*]{W}|art\.?{W}*\p{{Nd}}+|cr[ée]dito{W}|tabela{W}*\p{{Nd}}+|requisito{W})'"

STRUCTURED = f"""(len(r) > 1 and (
  len(list_filter(r, lambda l: contains(l, '|') or contains(l, chr(9)))) >= greatest(2.0::double, len(r) * 0.5::double)
  or len(list_filter(r, lambda l: regexp_matches(l, {LISTED}))) >= greatest(2.0::double, len(r) * 0.4::double)
  or (len(list_filter(r, lambda l: length({strip('l')}) < 50)) >= len(r) * 0.7::double and len(list_filter(r, lambda l: regexp_matches(l, '\\p{{Nd}}'))) >= len(r) * 0.5::double)))"""

HEADING = rf"""coalesce(len(r) between 1 and 2 and length(f) <= 90 and (
  regexp_matches(f, '(?i)^{W}*(CAP[ÍI]TULO|SE[ÇC][ÃA]O|T[ÍI]TULO|ANEXO|PARTE)([^\p{{L}}\p{{M}}\p{{N}}_]|$)') or regexp_matches(f, '(?i)^{W}*Art(?:igo)?\.?{W}*\p{{Nd}}+')
  or regexp_matches(f, '(?i)^{W}*Cr[ée]dito{W}+[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]') or regexp_matches(f, '^{W}*\p{{Nd}}+(\.\p{{Nd}}+){{0,3}}{W}+\p{{Lu}}[^.]{{0,80}}$')
  or (length(regexp_replace(f, '\P{{L}}', '', 'g')) >= 4 and not regexp_matches(f, '\p{{Ll}}|\p{{Lt}}|\p{{Lm}}|\p{{Lo}}') and not ends_with(f, '.'))), false)"""

BLOCK_ROWS = f"""
b as (select chunk_id, {blocks('text')} as b from {CHUNKS} where text is not null),
x as (select chunk_id, unnest(generate_series(0, len(b) - 1))::int as block_no, unnest(b) as block from b),
y as (select *, {filled(lines('block'))} as r from x),
z as (select *, {strip('r[1]')} as f from y)"""

PAGES = f"""
p as (select doc_id, chunk_id, coalesce(text, '') as text from {CHUNKS}),
l as (select doc_id, chunk_id, {lines('text')} as l from p),
f as (select doc_id, chunk_id, {filled('l')} as f from l),
k as (select distinct doc_id, chunk_id, unnest(list_transform(case when len(f) > 0 then list_concat(f[1:3], f[greatest(len(f) - 2, 1):]) else [] end, lambda x: {key('x')})) as key from f),
n as (select doc_id, count(*) as n from p group by doc_id),
r as (select doc_id, key, count(*) as pages from k join n using (doc_id) where key <> '' group by doc_id, key, n having n >= 4 and count(*) >= greatest(3, floor(n * 0.1::double)))"""

SAFE = "regexp_replace(text, '[<>&]', ' ', 'g')"
PAGE_HTML = f"('<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><!-- note --><p>' || replace({SAFE}, chr(10), '</p>' || chr(10) || '<p>') || '</p><script>a<b</script><footer>fim</footer></body></html>')"
MARKUP = "(?:<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "nav", "footer", "header", "noscript")) + "|<[!/?a-z][^>]*>)+"
VISIBLE = rf"regexp_replace(regexp_replace({PAGE_HTML}, '{MARKUP}', chr(10), 'gis'), '^\n|\n$', '', 'g')"

SENTENCES = rf"string_split(regexp_replace(text, '([.!?;:]){W}+(\p{{Lu}}|\p{{Nd}})', '\1' || chr(1) || '\2', 'g'), chr(1))"

REFERENCE = rf"'(?i)^{W}*(refer[êe]ncias({W}+bibliogr[áa]ficas)?|bibliografia|references){W}*:?{W}*$'"

TOPK = """
with q as (select vec_id as qid, embedding::double[] as q from embeddings where vec_id % 20 = 0),
d as (select qid, vec_id, round(1 - list_cosine_similarity(q, embedding::double[]), 9) as d from q, embeddings {where}),
r as (select *, row_number() over (partition by qid order by d, vec_id::varchar) as rank from d)
select qid, rank::int as rank, vec_id, round(d, 5) as distance from r where rank <= 5"""

HITS = f"""
h as (select *, row_number() over (partition by doc_id order by length(text) desc, chunk_id) as rank from {CHUNKS} where text is not null),
t as (select * from h where rank <= 3)"""

EXT = """case when lower({tipo}) in ('pdf', 'html', 'htm', 'docx', 'txt') then '.' || lower({tipo})
 when contains({ct}, 'pdf') then '.pdf' when contains({ct}, 'html') then '.html' when contains({ct}, 'word') or contains({ct}, 'officedocument') then '.docx'
 when ends_with({u}, '.pdf') then '.pdf' when ends_with({u}, '.docx') then '.docx' when ends_with({u}, '.html') then '.html' when ends_with({u}, '.htm') then '.htm' when ends_with({u}, '.txt') then '.txt' else '.pdf' end"""

CHARACTERS = rf"replace(regexp_replace({compatibility('text')}, '[\x{{a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g'), chr(65279), '')"

#: From ``base(id, text)`` to ``clean(id, text)``.
CLEAN = rf"""
c0 as (select id, regexp_replace({CHARACTERS}, '(\p{{Ll}})-\n(\p{{Ll}})', '\1\2', 'g') as text from base),
c1 as (select id, text, {lines('text')} as l from c0),
c2 as (select id, text, l, list_filter(generate_series(1, len(l)), lambda i: i - 1 > len(l) * 0.6::double and regexp_matches(l[i], {REFERENCE})) as hit from c1),
c3 as (select id, case when len(hit) > 0 then array_to_string(l[:hit[1] - 1], chr(10)) else text end as text from c2),
c4 as (select id, {filled(rf"""list_transform(string_split_regex(text, '\n{W}*\n'), lambda x: regexp_replace(x, '^\n+|\n+$', '', 'g'))""")} as b from c3),
c5 as (select id, unnest(generate_series(1, len(b))) as i, unnest(b) as block from c4),
c6 as (select *, {filled(lines('block'))} as r from c5),
c7 as (select id, i, case when {STRUCTURED} then array_to_string({filled(rf"""list_transform({lines('block')}, lambda l: regexp_replace(regexp_replace(l, '{W}+$', ''), '[ \t]{{2,}}', ' ', 'g'))""")}, chr(10))
  else {strip(r"regexp_replace(regexp_replace(block, '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')")} end as t from c6),
c8 as (select c3.id, coalesce(string_agg(t, chr(10) || chr(10) order by i), case when any_value(c3.text) is not null then '' end) as text from c3 left join c7 using (id) group by c3.id),
clean as (select id, {strip(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")} as text from c8)"""

#: Blocks of ``clean`` packed up to 256 tokens, large ones by sentences, chunks under 128 tokens merged.
SEGMENTS = rf"""
b as (select id, {blocks('text')} as b from clean where text is not null),
x as (select id, unnest(generate_series(1, len(b))) as i, unnest(b) as block from b), y as (select *, {filled(lines('block'))} as r from x), z as (select *, {strip('r[1]')} as f from y),
h as (select id, i, block, {tokens('block')} as n, {HEADING} as head, {strip(f"({lines(strip('block'))})[1]")} as title from z),
t as (select *, coalesce(last_value(case when head then title end ignore nulls) over (partition by id order by i rows unbounded preceding), id) as section from h),
p(id, i, c, n) as (
  select id, i, 0, case when n > 256 then 1000000 else n end from t where i = 1
  union all select t.id, t.i, case when t.head or t.n > 256 or p.n + t.n > 256 then p.c + 1 else p.c end,
    case when t.n > 256 then 1000000 when t.head or p.n + t.n > 256 then t.n else p.n + t.n end from p join t on t.id = p.id and t.i = p.i + 1),
packed as (select t.id, c, 0 as part, {strip("string_agg(block, chr(10) || chr(10) order by t.i)")} as text, sum(t.n) as n, last(section order by t.i) as section from p join t using (id, i) where t.n <= 256 group by t.id, c),
s0 as (select t.id, c, section, {SENTENCES.replace('text', 'block')} as s from p join t using (id, i) where t.n > 256),
s1 as (select id, c, section, unnest(generate_series(1, len(s))) as j, unnest(s) as s from s0), s2 as (select *, {tokens('s')} as n from s1),
s3(id, c, j, part, n) as (
  select id, c, j, 0, n from s2 where j = 1
  union all select s2.id, s2.c, s2.j, case when s3.n + s2.n > 256 then s3.part + 1 else s3.part end, case when s3.n + s2.n > 256 then s2.n else s3.n + s2.n end from s3 join s2 on s2.id = s3.id and s2.c = s3.c and s2.j = s3.j + 1),
pieces as (select s2.id, c, part, string_agg(s, ' ' order by j) as text, sum(s2.n) as n, any_value(section) as section from s3 join s2 using (id, c, j) group by s2.id, c, part),
u as (select *, row_number() over (partition by id order by c, part) as k from (select * from packed union all select * from pieces)),
m(id, k, o, n, section) as (
  select id, k, 0, n, section from u where k = 1
  union all select u.id, u.k, case when u.n < 128 and u.section = m.section and u.n + m.n <= 256 then m.o else m.o + 1 end, case when u.n < 128 and u.section = m.section and u.n + m.n <= 256 then u.n + m.n else u.n end, u.section from m join u on u.id = m.id and u.k = m.k + 1),
segments as (select u.id, o, any_value(u.section) as section, string_agg(u.text, chr(10) || chr(10) order by k) as text, sum(u.n)::int as n from m join u using (id, k) group by u.id, o)"""

#: The five best passages for the vector of every chunk whose number is divisible by 20.
STORED = f"""
i as (select *, embedding::double[] as v from {CHUNKS} where text is not null and len(embedding) = 768 and list_max(list_transform(embedding, lambda e: abs(e))) > 0),
q as (select 'O que diz ' || chunk_id || '?' as question, v as q from i where regexp_extract(chunk_id, '(\\d+)$', 1)::int % 20 = 0),
d as (select question, chunk_id, round(1 - list_cosine_similarity(q, v), 9) as d from q, i {{where}}),
o as (select *, row_number() over (partition by question order by d, chunk_id) as rank from d),
f as (select o.*, 1 - d as score, i.* exclude (chunk_id, embedding, v) from o join i using (chunk_id) where rank <= 5)"""
#: First sentence of the best passage with its citation, else the refusal.
SENTENCE = r"regexp_extract(text, '(?s)^\s*(.+?[.!?])(?:\s|$)', 1)"
ANSWERED = f"""a as (select question, case when {SENTENCE} = '' then 'A informação não está no corpus consultado.' else trim({SENTENCE} || ' [1]') end as answer, coalesce(fonte, '?') || ' (' || printf('%.3f', round(score, 3)) || ')' as top from f where rank = 1)"""
COVERED = "not contains(lower(answer), 'não está no corpus')"

#: Catalogue rows, each once.
CATALOGUE = "(select distinct id, titulo, fonte, categoria, ano, tipo, url, insecure from manifest where id is not null)"

ORACLES: dict[str, str] = {
    "format_resolution": f"select distinct id, {EXT.format(tipo='coalesce(tipo, chr(0))', ct='chr(0)', u='lower(coalesce(url, chr(0)))')} as ext from manifest",
    "format_resolution_by_address": f"select distinct id, {EXT.format(tipo='chr(0)', ct='c', u='lower(coalesce(url, chr(0)))')} as ext from (select *, case when ano % 5 = 0 then 'text/html; charset=utf-8' when ano % 5 = 1 then 'application/msword' else '' end as c from manifest_status)",
    "missing_files": "select distinct id from manifest m where not exists (select 1 from manifest_status s where s.id = m.id and s.downloaded)",
    "located_files": "select m.id, min(s.local_path) as path from (select distinct id from manifest) m left join manifest_status s on s.id = m.id and s.downloaded group by m.id",
    "fetch_summary": "select count(*) as total, count(*) filter (downloaded) as ok, count(*) filter (not coalesce(downloaded, false)) as failed, round(coalesce(sum(bytes), 0) / 1024.0::double, 1) as kb from manifest_status",
    "path_parts": r"select distinct id, regexp_extract(local_path, '([^/\\]*)$', 1) as name, lower(regexp_extract(regexp_extract(local_path, '([^/\\]*)$', 1), '[^.](\.[^.]+)$', 1)) as suffix from manifest_status",
    "html_visible_text": f"select doc_id, {VISIBLE} as text from documents",
    "html_char_stats": f"select source, sum(length({PAGE_HTML}))::bigint as chars_raw, sum(length({VISIBLE}))::bigint as chars_text from documents group by source",
    "line_norm_keys": f"with l as (select doc_id, {lines('text')} as l from documents) select doc_id, unnest(generate_series(0, len(l) - 1))::int as line_no, unnest(list_transform(l, lambda x: {key('x')})) as key from l",
    "repeated_lines": f"with {PAGES} select doc_id, key, pages from r",
    "header_stripped_pages": f"""with {PAGES}, a as (select doc_id, list(key) as keys from r group by doc_id)
select chunk_id, coalesce(array_to_string(list_filter(l, lambda x: not coalesce(list_contains(keys, {key('x')}), false) and not regexp_matches(x, {PAGE})), chr(10)), '') as text, coalesce(len(keys), 0)::int as n_headers from l left join a using (doc_id)""",
    "page_number_lines": f"with l as (select doc_id, unnest({lines('''(text || chr(10) || 'Pág. ' || (doc_id % 1000) || ' de 40' || chr(10) || doc_id)''')}) as line from documents) select doc_id, count(*) as n from l where regexp_matches(line, {PAGE}) group by doc_id",
    "references_cut": f"""with t as (select doc_id, text || case when doc_id % 3 = 0 then chr(10) || 'REFERÊNCIAS Bibliográficas :' || chr(10) || '[1] Norma local.' else chr(10) || 'Referências e notas' end as text from documents),
l as (select doc_id, text, {lines('text')} as l from t),
i as (select doc_id, text, l, list_filter(generate_series(1, len(l)), lambda i: i - 1 > len(l) * 0.6::double and regexp_matches(l[i], {REFERENCE})) as hit from l)
select doc_id, case when len(hit) = 0 then text else array_to_string(l[:hit[1] - 1], chr(10)) end as text from i""",
    "dehyphenated": r"select doc_id, regexp_replace(regexp_replace(text, '([aeo])([nrs])', '\1-' || chr(10) || '\2', 'g'), '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g') as text from documents",
    "unicode_spaces": rf"select chunk_id, replace(regexp_replace(chr(65279) || text || chr(8201) || chr(8203) || '.', '[\x{{a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g'), chr(65279), '') as text from {CHUNKS}",
    "structured_blocks": f"with {BLOCK_ROWS} select chunk_id, block_no, {STRUCTURED} as structured from z",
    "heading_flags": f"with {BLOCK_ROWS} select chunk_id, block_no, {HEADING} as heading from z",
    "section_carry": f"""with {BLOCK_ROWS}, h as (select *, {HEADING} as heading, {strip(f"({lines(strip('block'))})[1]")} as title from z)
select chunk_id, block_no, heading, coalesce(last_value(case when heading then title end ignore nulls) over (partition by chunk_id order by block_no rows unbounded preceding), chunk_id) as section from h""",
    "normalised_blocks": f"""with b as (select doc_id, {filled(rf'''list_transform(string_split_regex(text, '\n{W}*\n'), lambda x: regexp_replace(x, '^\n+|\n+$', '', 'g'))''')} as b from documents),
x as (select doc_id, unnest(generate_series(1, len(b))) as i, unnest(b) as block from b),
y as (select *, {filled(lines('block'))} as r from x),
z as (select doc_id, i, case when {STRUCTURED} then array_to_string({filled(rf'''list_transform({lines('block')}, lambda l: regexp_replace(regexp_replace(l, '{W}+$', ''), '[ \t]{{2,}}', ' ', 'g'))''')}, chr(10))
  else {strip(r"regexp_replace(regexp_replace(block, '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')")} end as t from y)
select d.doc_id, coalesce(string_agg(t, chr(10) || chr(10) order by i), case when any_value(d.text) is not null then '' end) as text from documents d left join z using (doc_id) group by d.doc_id""",
    "document_excerpts": "select doc_id, left(text, 55) || '...' as excerpt from documents",
    "token_counts": rf"select doc_id, {tokens('''coalesce(text, '')''')}::int as tokens, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+'))::int as words from documents",
    "token_histogram": f"""with v as (select n_tokens::double as v from {CHUNKS} where n_tokens is not null), e as (select min(v) as a, max(v) as b from v),
h as (select case when b = a then 30 else least(30, floor((v - a) / ((b - a) / 30.0::double))::int + 1) end as bin, a, (b - a) / 30.0::double as w from v, e)
select bin, round(a + (bin - 1) * w, 6) as low, round(a + bin * w, 6) as high, count(*) as n from h group by bin, a, w""",
    "sentence_split": f"with s as (select doc_id, {SENTENCES} as s from documents where text is not null) select doc_id, unnest(generate_series(0, len(s) - 1))::int as sentence_no, unnest(s) as sentence from s",
    "sentence_pack": f"""with recursive s as (select doc_id, {SENTENCES} as s from documents where text is not null),
x as (select doc_id, unnest(generate_series(1, len(s))) as i, unnest(s) as s from s), t as (select doc_id, i, s, {tokens('s')} as n from x),
p(doc_id, i, piece_no, n) as (
  select doc_id, i, 0, n from t where i = 1
  union all select t.doc_id, t.i, case when p.n + t.n > 120 then p.piece_no + 1 else p.piece_no end, case when p.n + t.n > 120 then t.n else p.n + t.n end from p join t on t.doc_id = p.doc_id and t.i = p.i + 1)
select doc_id, piece_no, string_agg(s, ' ' order by i) as piece from p join t using (doc_id, i) group by doc_id, piece_no""",
    "block_pack": f"""with recursive b as (select doc_id, {blocks('text')} as b from documents where text is not null),
x as (select doc_id, unnest(generate_series(1, len(b))) as i, unnest(b) as block from b), y as (select *, {filled(lines('block'))} as r from x), z as (select *, {strip('r[1]')} as f from y),
t as (select doc_id, i, {tokens('block')} as n, {HEADING} as head from z),
p(doc_id, i, c, n) as (
  select doc_id, i, 0, case when n > 200 then 1000000 else n end from t where i = 1
  union all select t.doc_id, t.i, case when t.head or t.n > 200 or p.n + t.n > 200 then p.c + 1 else p.c end,
    case when t.n > 200 then 1000000 when t.head or p.n + t.n > 200 then t.n else p.n + t.n end from p join t on t.doc_id = p.doc_id and t.i = p.i + 1)
select doc_id, c as chunk_no, (min(i) - 1)::int as first_block, (max(i) - 1)::int as last_block from p group by doc_id, c""",
    "document_metadata": "with m as (select id, min(titulo) as titulo, min(fonte) as fonte, min(categoria) as categoria, min(subcategoria) as subcategoria, min(ano)::varchar as ano, min(vigencia) as vigencia, min(url) as url from manifest group by id) select d.doc_id, titulo, fonte, categoria, subcategoria, ano, vigencia, url from (select distinct doc_id from chunks where chunk_id is not null) d left join m on m.id = d.doc_id",
    "chunk_report_sets": f"""with c as (select coalesce(categoria, '?') as categoria, coalesce(subcategoria, '?') as subcategoria, coalesce(doc_id, '?') as doc_id, n_tokens from {CHUNKS})
select case grouping(categoria, subcategoria, doc_id) when 3 then 'categoria' when 5 then 'subcategoria' when 6 then 'documento' else 'total' end as grupo, coalesce(categoria, subcategoria, doc_id, '') as valor,
  count(*) as chunks, round(avg(n_tokens), 1) as tokens_medio, min(n_tokens) as tokens_min, max(n_tokens) as tokens_max from c group by grouping sets ((), (categoria), (subcategoria), (doc_id))""",
    "chunk_report": f"select count(*) as total_chunks, round(avg(n_tokens), 1) as tokens_medio, min(n_tokens) as tokens_min, max(n_tokens) as tokens_max, count(distinct coalesce(categoria, '?'))::int as categorias, count(distinct coalesce(doc_id, '?'))::int as documentos from {CHUNKS}",
    "category_counts": "select categoria, count(*) as n from manifest group by categoria",
    "category_labels": "select distinct subcategoria from chunks",
    "middle_chunk": f"with r as (select doc_id, chunk_id, row_number() over (partition by doc_id order by chunk_id) as i, count(*) over (partition by doc_id) as n from {CHUNKS}) select doc_id, chunk_id from r where i - 1 = n // 2",
    "event_windows": "select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", event_type, count(*) as n from events group by all",
    "metadata_sanitised": f"select chunk_id, {', '.join(f'''coalesce({c}, '') as {c}''' for c in ('doc_id', 'titulo', 'fonte', 'categoria', 'subcategoria', 'ano', 'vigencia', 'url', 'section'))}, coalesce(n_tokens, 0) as n_tokens from {CHUNKS}",
    "index_counts": "select categoria, count(*) as n from (select chunk_id, any_value(categoria) as categoria from chunks where embedding is not null and chunk_id is not null group by chunk_id) group by categoria",
    "vector_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, 1.0::double as unit_norm from embeddings",
    "cosine_topk": TOPK.format(where=""),
    "cosine_topk_filtered": TOPK.format(where="where label = 3"),
    "where_operators": "select distinct id from manifest where (ano >= 2010 and ano < 2015 and categoria <> 'norma_certificacao') or (subcategoria in ('agua', 'ambos') and tipo not in ('pdf') and ano > 2020) or ano = 1999",
    "context_strings": f"""with {HITS}, c as (select doc_id as id, string_agg('[' || rank || '] (Fonte: ' || coalesce(fonte, '?') || ' - ' || coalesce(titulo, '?') || ', ' || coalesce(ano, '?') || case when coalesce(section, '') <> '' then '; seção: ' || section else '' end || ')' || chr(10) || text, chr(10) || chr(10) order by rank) as context from t group by doc_id)
select id, context, 'CONTEXTO:' || chr(10) || context || chr(10) || chr(10) || 'PERGUNTA: O que diz ' || id || '?' || chr(10) || chr(10) || 'Responda citando as fontes pelos números entre colchetes.' as prompt from c""",
    "citation_labels": f"""with {HITS}, o as (select doc_id, coalesce(fonte, '?') || ' (' || printf('%.3f', round(1.0::double / (length(text) + 1), 3)) || ')' as top from t where rank = 1)
select t.doc_id as id, top, (rank - 1)::int as i, '[' || rank || '] ' || coalesce(fonte, '?') || ', ' || coalesce(titulo, '?') as label from t join o using (doc_id)""",
    "answer_coverage": "select count(*) as perguntas, count(*) filter (resposta is not null and not contains(lower(resposta), 'não está no corpus')) as cobertas, round(count(*) filter (resposta is not null and not contains(lower(resposta), 'não está no corpus')) / greatest(1, count(*))::double, 6) as taxa from avaliacao",
    "coverage_labels": "select distinct n, case when resposta is not null and not contains(lower(resposta), 'não está no corpus') then 'sim' else 'não (sem cobertura)' end as cobertura, coalesce(fontes[1], '') as primeira from avaliacao",
    "compared_questions": "select pergunta, count(distinct n) as respostas, count(*) filter (resposta is not null and not contains(lower(resposta), 'não está no corpus')) as cobertas from avaliacao where pergunta in (select q from perguntas where comparar) group by pergunta",
    "compatibility_form": f"select chunk_id, {CHARACTERS} as text from {CHUNKS}",
    "clean_texts": f"with base as (select chunk_id as id, text from {CHUNKS}), {CLEAN} select id as chunk_id, text from clean",
    "clean_diagnostics": f"""with {PAGES}, a as (select doc_id, list(key) as keys from r group by doc_id),
s as (select doc_id, regexp_extract(chunk_id, '(\\d+)$', 1)::int as page_no, coalesce(array_to_string(list_filter(l, lambda x: not coalesce(list_contains(keys, {key('x')}), false) and not regexp_matches(x, {PAGE})), chr(10)), '') as text from l left join a using (doc_id)),
base as (select doc_id as id, string_agg(text, chr(10) || chr(10) order by page_no, text) as text from s group by doc_id), {CLEAN}
select doc_id, n.n_pages, n.n_chars_raw, length(text) as n_chars_clean, coalesce(len(keys), 0)::int as n_headers
from (select doc_id, count(*)::int as n_pages, sum(length(text))::bigint as n_chars_raw from p group by doc_id) n join clean on id = doc_id left join a using (doc_id)""",
    "document_chunks": f"""with recursive base as (select doc_id::varchar as id, text from documents), {CLEAN}, {SEGMENTS}
select id || '::' || lpad(o::varchar, greatest(3, len(o::varchar))::int, '0') as chunk_id, id::bigint as doc_id, d.source as fonte, section, n as n_tokens, segments.text from segments join documents d on d.doc_id = id::bigint""",
    "passage_vectors": f"select chunk_id, 256 as dim, 1.0::double as norm from {CHUNKS} where text is not null",
    "question_hits": f"with {STORED.format(where='')} select question, rank::int as rank, chunk_id, round(score, 6) as score from f",
    "question_answers": f"with {STORED.format(where='')}, {ANSWERED} select row_number() over (order by question) as n, question as pergunta, {COVERED} as coberta, answer as resposta, top as fonte_top from a",
    "filtered_answers": f"""with {STORED.format(where="where subcategoria = 'energia'")}, {ANSWERED}, c as (select question, count(*)::int as n_sources from f group by question)
select question, coalesce(answer, 'A informação não está no corpus consultado.') as answer, coalesce(n_sources, 0) as n_sources from q left join a using (question) left join c using (question)""",
    "answer_comparison": f"""with {STORED.format(where='')}, {ANSWERED}, c as (select question, string_agg('[' || rank || '] ' || coalesce(fonte, '?'), '; ' order by rank) as fontes_rag from f where rank <= 3 group by question)
select question as pergunta, answer as rag, fontes_rag, 'Sem contexto: ' || question as puro from a join c using (question) where length(question) % 2 = 0""",
    "answer_sources": f"with {STORED.format(where='')} select question, rank::int as n, titulo, fonte, ano, vigencia, categoria, subcategoria, section, doc_id, round(score, 3) as score from f",
    "chat_messages": f"""with {HITS}, c as (select doc_id as id, string_agg('[' || rank || '] (Fonte: ' || coalesce(fonte, '?') || ' - ' || coalesce(titulo, '?') || ', ' || coalesce(ano, '?') || case when coalesce(section, '') <> '' then '; seção: ' || section else '' end || ')' || chr(10) || text, chr(10) || chr(10) order by rank) as context from t group by doc_id),
u as (select id, 'CONTEXTO:' || chr(10) || context || chr(10) || chr(10) || 'PERGUNTA: O que diz ' || id || '?' || chr(10) || chr(10) || 'Responda citando as fontes pelos números entre colchetes.' as prompt from c)
select id, 0 as turn, 'system' as role, {quoted(SYSTEM_RAG)} as content from u union all select id, 1, 'user', prompt from u""",
    "manifest_json": f"select id, titulo, fonte, categoria, ano::varchar as ano, tipo, url, insecure from {CATALOGUE}",
    "text_files": "select doc_id::varchar as doc_id, 1 as page_no, text from documents where text is not null",
    "chunk_lines": f"select chunk_id, doc_id, titulo, fonte, categoria, ano, section, n_tokens::varchar as n_tokens, text from {CHUNKS}",
    "report_json": f"select count(*) as total_chunks, round(avg(n_tokens), 1) as tokens_medio, min(n_tokens)::bigint as tokens_min, max(n_tokens)::bigint as tokens_max from {CHUNKS}",
    "index_growth": f"select coalesce(categoria, '') as categoria, count(*) as chunks, count(*) filter (len(embedding) > 0) as vectors from {CHUNKS} group by 1",
    "fetched_pages": f"select id as doc_id, case when tipo <> 'pdf' then url end as text, case when tipo = 'pdf' then 'no pages' end as error from {CATALOGUE}",
    "fetched_totals": f"select count(*) as total, count(*) as ok, 0::bigint as failed from {CATALOGUE}",
    "first_by_fonte": f"select fonte, min_by(chunk_id, chunk_id) as chunk_id, left(min_by(text, chunk_id), 900) as excerpt from {CHUNKS} where fonte is not null group by fonte",
    "flagship": f"""with recursive base as (select chunk_id as id, text from {CHUNKS} where text is not null), {CLEAN}, {SEGMENTS},
i as (select id || '::' || lpad(o::varchar, greatest(3, len(o::varchar))::int, '0') as piece_id, id as chunk_id, segments.section, segments.n, e.embedding::double[] as v, e.fonte, e.doc_id
  from segments join {CHUNKS} e on e.chunk_id = id where len(e.embedding) = 768 and list_max(list_transform(e.embedding, lambda x: abs(x))) > 0),
q as (select distinct 'O que diz ' || chunk_id || '?' as question, v as q from i where regexp_extract(chunk_id, '(\\d+)$', 1)::int % 20 = 0),
d as (select question, piece_id, round(1 - list_cosine_similarity(q, v), 9) as d from q, i),
o as (select *, row_number() over (partition by question order by d, piece_id) as rank from d)
select question, rank::int as rank, i.piece_id, i.doc_id, i.fonte, i.section, round(1 - d, 6) as score from o join i using (piece_id) where rank <= 5""",
}
