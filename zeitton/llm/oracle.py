"""The same rows in plain SQL, where SQL can express the operator."""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

LINES = """
split as (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as parts from documents),
line as (select doc_id, source, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split)
"""

OP3 = f"""
with {LINES},
keyed as (select doc_id, line, pos, translate(trim(line, {SPACE}), {UPPER}, {LOWER}) as key from line),
repeated as (
    select key, min(doc_id) as first from keyed where length(key) >= 10
    group by key having count(distinct doc_id) >= 2
),
marked as (
    select k.doc_id, line, pos, coalesce(k.doc_id <> first, false) as gone
    from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP5 = f"""
with {LINES},
counted as (
    select doc_id, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
    from documents
),
word as (select doc_id, unnest(words) as a, generate_subscripts(words, 1) as i from counted),
windowed as (
    select doc_id, i, a, lead(a) over w as b, lead(a, 2) over w as c from word
    window w as (partition by doc_id order by i)
),
twice as (
    select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windowed where c is not null
),
repeat_words as (
    select doc_id, count(distinct spot) as n_repeat_words
    from (select doc_id, unnest([i, i + 1, i + 2]) as spot from twice where n > 1) group by doc_id
),
own_lines as (
    select doc_id, count(*) - count(distinct line) as n_dup_lines
    from line where trim(line, {SPACE}) <> '' group by doc_id
),
bare as (select doc_id, source, trim(line, {SPACE}) as bare from line),
key as (
    select doc_id, source, lower(bare) as key,
        len(list_filter(regexp_split_to_array(bare, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words
    from bare where length(bare) >= 10
),
host as (select source, count(distinct doc_id) as n from documents group by source),
common as (
    select k.source, key, min(doc_id) as first from key k join host h on k.source = h.source
    group by k.source, key having count(distinct doc_id) > 5 and 100 * count(distinct doc_id) > 10 * any_value(n)
),
lost as (
    select k.doc_id, sum(words)::bigint as lost from key k join common c on k.source = c.source and k.key = c.key
    where k.doc_id <> first group by k.doc_id
),
measured as (
    select c.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        coalesce(lost, 0) as n_removed_words
    from counted c left join own_lines o on c.doc_id = o.doc_id
    left join repeat_words r on c.doc_id = r.doc_id left join lost l on c.doc_id = l.doc_id
),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select *, not base_failed and 100 * n_removed_words <= 70 * n_words as kept from judged
"""

OP6 = """
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -1, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v (t, r)
),
shown as (
    select *, case when role = 'assistant' then text else '' end as learned,
        replace(replace(role, '\\', '\\\\'), '<|', '<\\|') as role_shown,
        replace(replace(text, '\\', '\\\\'), '<|', '<\\|') as text_shown
    from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    sum(length(learned))::bigint as loss_chars,
    sha256(string_agg(learned, '' order by turn, role, text)) as loss_sha256,
    sum(length('<|turn|>' || role_shown || '<|text|>' || text_shown || '<|end|>'))::bigint as formatted_chars
from shown group by conv_id
"""

OP7 = f"""
with rest as (
    select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages
),
parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER}, {LOWER}) as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from rest
),
rules as (
    select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')) as r (rule_host, rule_path, rule_verdict)
)
select page_id, host, path, rule_host || rule_path as rule, coalesce(rule_verdict, 'allow') as verdict
from parts left join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by page_id order by length(rule_host) desc, length(rule_path) desc) = 1
"""

OP9 = """
with recursive vec as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link as (
    select a.vec_id as a, b.vec_id as b from vec a join vec b
        on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.93
),
reach (a, b) as (
    select vec_id, vec_id from embeddings
    union
    select reach.a, link.b from reach join link on reach.b = link.a
),
counted as (select a, count(*) as n from link group by a),
component as (select a, min(b) as component_id from reach group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join component c on vec_id = c.a left join counted n on vec_id = n.a
"""

OP13 = """
with vec as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
score as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
    from vec a join vec b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positive as (
    select anchor_id, vec_id as positive_id, score as positive_score from score where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
),
ranked as (
    select p.*, n.vec_id as negative_id, n.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id)::int as rank
    from positive p join score n on p.anchor_id = n.anchor_id and not n.same
        and 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""

SQL = {
    "op3_line_dedup": OP3, "op5_quality_rules": OP5, "op6_chat_format": OP6, "op7_url_filter": OP7, "op9_embedding_dedup": OP9,
    "op13_hard_negatives": OP13,
}
