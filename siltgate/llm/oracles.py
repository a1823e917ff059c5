"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import mixing

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, and the closure of the links. Ids are taken to be unique and not null.
MINHASH = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
link as (select x, y from p union all select y, x from p),
reach as (select doc_id as x, doc_id as y from s union select r.x, l.y from reach r join link l on l.x = r.y),
c as (select x, min(y) as component_id from reach group by x)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on c.x = s.doc_id"""


def urls(rules: list[tuple[str, str]]) -> str:
    table = ", ".join(f"('{h}', '/{p}', '{r}', '{v}')" for r, v in rules for h, _, p in [r.partition("/")])
    return f"""with r as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest, row_number() over () as k from pages),
    p as (select k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
    m as (select k, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from p join (values {table}) as t(rhost, rpath, rule, verdict)
    on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath) group by k)
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (k)"""


def mix(rounds: int = 10) -> str:
    """The raking steps unrolled, one common table a step."""
    steps = ["""d as (select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as n_tokens, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) as bars from documents)""",
             "r as (select *, case when bars >= 8 then 'table' when n_tokens < 50 then 'snippet' else 'prose' end as topic from d)",
             "c as (select source, lang, topic, sum(n_tokens)::double / (select sum(n_tokens) from r) as share from r group by all)"]
    for m in mixing.MARGINS:
        steps.append(f"t_{m} as (select {m}, power(s, {mixing.POWERS[m]}) / sum(power(s, {mixing.POWERS[m]})) over () as t from (select {m}, sum(share) as s from c group by {m}))")
    joins = " ".join(f"join t_{m} on t_{m}.{m} is not distinct from c.{m}" for m in mixing.MARGINS)
    steps.append(f"w0 as (select c.*, {', '.join(f't_{m}.t as to_{m}' for m in mixing.MARGINS)}, share as w from c {joins})")
    n = 0
    for _ in range(rounds):
        for m in mixing.MARGINS:
            steps.append(f"w{n + 1} as materialized (select * replace (case when sum(w) over (partition by {m}) > 0 then w * to_{m} / sum(w) over (partition by {m}) else 0 end as w) from w{n})")
            n += 1
    steps.append(f"f as (select source, lang, topic, case when share > 0 then w / share else 0 end as weight from w{n})")
    steps.append("g as (select *, weight / (select max(weight) from f) as p from f)")
    return f"""with {', '.join(steps)} select doc_id, r.source, r.lang, r.topic, n_tokens, round(weight, 6) as weight, round(p, 6) as probability,
    ('0x' || substr(md5('mix:' || doc_id), 1, 8))::bigint / 4294967296.0 < p as kept
    from r join g on g.source is not distinct from r.source and g.lang is not distinct from r.lang and g.topic = r.topic"""


#: Pages of 64 samples a row and 16,384 rows at most hold a text's bytes and zeros up to a multiple of 64.
PAGES = """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
padded as (select doc_id, rpad(h, greatest(128, (128 * ceil(length(h) / 128.0))::int), '0') as h from raw),
paged as (select doc_id, h, unnest(range(((length(h) - 1) // 2097152)::bigint + 1)) as page from padded),
cut as (select doc_id, page, substr(h, 2097152 * page + 1, 2097152) as h from paged)
select doc_id, page::int as page, 64 as width, (length(h) // 128)::int as height, 1 as samples, 8 as bits,
  sha256(unhex(h)) as pixels_sha256, cast(null as varchar) as error
from cut
"""


def _field(c: str) -> str:
    return f"coalesce(concat(octet_length(encode({c}::varchar)), ':', {c}), '-')"


_LEAF = "sha256(concat(" + ", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: One step of the checksum a bit; a byte is mixed in before eight of them (-1).
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: list_prepend(ascii(x)::bigint, [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))), lambda c, o: case when o >= 0 then xor(c, o) else xor(c >> 1, case when (c & 1) = 1 then 3988292384 else 0 end) end), 4294967295)"


def _climb(name: str, start: str) -> str:
    """All levels of the trees over ``start(g, pos, d)``: g, lvl, pos, d and n, how many nodes the level has."""
    return f"""{name} as (select g, 0 as lvl, pos, d, count(*) over (partition by g) as n from {start} union all
    select g, lvl + 1, pos // 16, sha256(string_agg(d, '' order by pos)), any_value((n + 15) // 16) from {name} where n > 1 group by g, lvl, pos // 16)"""


def _beside(name: str, tree: str) -> str:
    """Each start node's siblings by level: what stands left and right of it in its run."""
    return f"""{name} as (select a.g, a.pos, l.lvl, coalesce(string_agg(s.d, '' order by s.pos) filter (s.pos < a.pos // pow(16, l.lvl)::bigint), '') as l, coalesce(string_agg(s.d, '' order by s.pos) filter (s.pos > a.pos // pow(16, l.lvl)::bigint), '') as r
    from {tree} a join (select distinct g, lvl from {tree} where n > 1) l on l.g = a.g join {tree} s on s.g = a.g and s.lvl = l.lvl and s.pos // 16 = a.pos // pow(16, l.lvl + 1)::bigint where a.lvl = 0 group by all)"""


#: Trees by source and one over the sources, climbed level by level. Ids are taken to be unique.
MERKLE = f"""with recursive base as (select *, case when source is null then '-' else concat('=', source) end as g, {_LEAF.format(text="text")} as d, case when {_CRC} % 5 = 0 and text is not null then {_LEAF.format(text=_AZ)} end as t from documents),
low0 as (select *, row_number() over (partition by g order by doc_id) - 1 as pos from base),
{_climb("low", "low0")},
top0 as (select '' as g, row_number() over (order by encode(g)) - 1 as pos, d, g as src from low where n = 1),
{_climb("top", "top0")},
{_beside("lowb", "low")},
{_beside("topb", "top")},
steps as (select g, pos, lvl, l, r from lowb union all select z.g, z.pos, 1000 + b.lvl, b.l, b.r from low0 z join top0 q on q.src = z.g join topb b on b.pos = q.pos),
path as (select g, pos, list(concat(l, '|', r) order by lvl) as p from steps group by all)
select doc_id, z.d as leaf, q.d as subroot, (select d from top where n = 1) as root,
  sha256(replace(array_to_string(coalesce(p, []), ''), '|', '')) as proof_sha256,
  list_reduce(list_prepend(coalesce(t, z.d), coalesce(p, [])), lambda d, x: sha256(concat(split_part(x, '|', 1), d, split_part(x, '|', 2)))) as folded_root,
  list_reduce(list_prepend(coalesce(t, z.d), coalesce(p, [])), lambda d, x: sha256(concat(split_part(x, '|', 1), d, split_part(x, '|', 2)))) = (select d from top where n = 1) as verified
from low0 z join top0 q on q.src = z.g left join path on path.g = z.g and path.pos = z.pos"""

#: Every anchor against every row.
HARD_NEGATIVES = """with base as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as al, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint as score from base a join base b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, al, vec_id as positive_id, score as ps from s where label = al qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, ps as positive_score, score as negative_score
from p join s using (anchor_id) where s.label <> p.al and 50 * ps <= 100 * score and 100 * score <= 95 * ps qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3"""
