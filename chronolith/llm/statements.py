"""Check statements of the corpus queries that SQL can express."""

# crc32 of a list of bytes: one table of 256 entries, then one step a byte
_CRC_TABLE = """crc_table as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def _crc(byte_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    """Bytes of a text of code points below U+0100."""
    return f"""flatten(list_transform(string_split({text}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint]
        else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end))"""


SPELLING_VARIANTS = f"""
with recursive {_CRC_TABLE},
runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run
    from documents),
told as (select coalesce(doc_id::varchar, '') || ':' || run as key, run, count(*) as n from runs group by 1, 2),
hashed as (select run, n, {_crc(_bytes("key"))} as h from told, crc_table),
slips as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from slips where length(word) >= 6 group by word having sum(n) >= 5),
less as (select word, n, length(word) as size, i, substr(word, 1, i) || substr(word, i + 2) as rest
    from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
    select a.word, a.n, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, a.n, b.word, b.n from less a join words b on a.rest = b.word
    union select b.word, b.n, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from pairs group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n
    from words w left join best using (word)),
steps as (select word, word as reached, 0 as k from words union all select s.word, f.form, k + 1 from steps s join forms f on s.reached = f.word where f.form is not null)
select f.word, f.form, s.root, f.n, f.n_near, f.form_n from forms f join (select word, arg_max(reached, k) as root from steps group by word) s using (word)
"""

CONVERSATION_TRIE = f"""
with {_CRC_TABLE},
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_crc("list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::bigint)")} % 6 as h
    from (select distinct conv_id from conversations), crc_table),
rebuilt as (
    select c.conv_id, 0 as part, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
    union all select c.conv_id, 1, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
lines as (select conv_id, list({{'role': role, 'text': text}} order by part, pos) as line from rebuilt group by conv_id),
whole as (select c.conv_id, coalesce(line, []) as line from convs c left join lines using (conv_id)),
members as (select conv_id, unnest(range(len(line) + 1)) as depth, line from whole),
named as (select conv_id, depth, line[1:depth] as prefix, len(line) = depth as ends, case when depth > 0 then length(line[depth].text) else 0 end as chars from members),
nodes as (
    select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
        sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
    from named group by prefix, depth),
linked as (
    select n.*, p.conv_id as parent_conv_id, coalesce(k.n, 0) as n_children from nodes n
    left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
    left join (select prefix[1:depth - 1] as prefix, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by 1, 2) k on k.prefix = n.prefix and k.depth = n.depth),
spread as (select prefix, depth, unnest(range(depth + 1)) as up, n_children, (n_convs - 1) * chars as saved from linked),
totals as (select prefix[1:up] as prefix, up as depth, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from spread group by 1, 2)
select l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, t.n_leaves, t.saved_tokens, l.ends_sha256
from linked l join totals t on t.prefix = l.prefix and t.depth = l.depth
"""
