"""DuckDB SQL of the registered queries that SQL can express, each written independently of the operator."""

from __future__ import annotations

from . import licences as _licences

OP1 = r"""
with lines as (
  select doc_id, p - 1 as pos, string_split(text, chr(10))[p] as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as p from documents where text is not null)
), long as (select * from lines where length(line) >= 20
), firsts as (
  select line, length(line) as n, doc_id, pos from (select *, row_number() over (partition by line order by doc_id, pos) as r from long) where r = 1
), halves as (
  select x.line as a, y.line as b, x.n as na, y.n as nb, x.doc_id as da, x.pos as pa, y.doc_id as db, y.pos as pb
  from firsts x join firsts y on left(x.line, (x.n // 2)::int) = left(y.line, (x.n // 2)::int) and y.n in (x.n, x.n + 1) and x.line <> y.line
  union
  select x.line, y.line, x.n, y.n, x.doc_id, x.pos, y.doc_id, y.pos
  from firsts x join firsts y on right(x.line, (x.n - x.n // 2)::int) = right(y.line, (x.n - x.n // 2)::int) and y.n in (x.n, x.n + 1) and x.line <> y.line
), near as (
  select distinct case when (da, pa) < (db, pb) then db else da end as doc_id, case when (da, pa) < (db, pb) then pb else pa end as pos
  from halves
  where len(list_filter(range(0, nb), lambda p: left(a, p::int) = left(b, p::int) and substr(b, p::int + 2) = substr(a, case when na = nb then p::int + 2 else p::int + 1 end))) > 0
), marked as (
  select l.doc_id, l.pos, l.line, length(l.line) >= 20 and (f.doc_id, f.pos) < (l.doc_id, l.pos) as is_exact, n.pos is not null as is_near
  from lines l left join firsts f on f.line = l.line left join near n on n.doc_id = l.doc_id and n.pos = l.pos
)
select d.doc_id, coalesce(m.n_lines, 0)::bigint as n_lines, coalesce(m.n_exact, 0)::bigint as n_exact, coalesce(m.n_near, 0)::bigint as n_near,
  case when coalesce(m.n_exact, 0) + coalesce(m.n_near, 0) > 0 then coalesce(m.kept, '') else d.text end as text
from documents d left join (
  select doc_id, count(*) filter (line <> '') as n_lines, count(*) filter (coalesce(is_exact, false)) as n_exact, count(*) filter (is_near) as n_near,
    string_agg(line, chr(10) order by pos) filter (not coalesce(is_exact, false) and not is_near) as kept
  from marked group by doc_id) m on m.doc_id = d.doc_id
"""

OP2 = r"""
with docs as (
  select doc_id, source, text, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from docs)
), again as (
  select doc_id, i from windows where (doc_id, w) in (select (doc_id, w) from windows group by doc_id, w having count(*) > 1)
), repeats as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id
), lines as (
  select doc_id, source, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as k,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from documents where text is not null) where regexp_matches(line, '[^\x20\x09-\x0D]')
), above as (
  select source, k from (select source, k, count(distinct text) as c from lines group by source, k)
  join (select source as s, count(distinct text) as hosted from documents where text is not null group by source) on s is not distinct from source
  where c >= 10 and c >= 0.10 * hosted
), removed as (
  select doc_id, sum(n) as n from lines l where exists (select 1 from above a where a.source is not distinct from l.source and a.k = l.k) group by doc_id
), dups as (select doc_id, count(*) - count(distinct line) as n from lines group by doc_id
), counted as (
  select d.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dups.n, 0)::bigint as n_dup_lines,
    coalesce(repeats.n, 0)::bigint as n_repeat_words, coalesce(removed.n, 0)::bigint as n_removed_words
  from docs d left join repeats using (doc_id) left join dups using (doc_id) left join removed using (doc_id)
), failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted)
select *, not base_failed and n_removed_words <= 0.5 * n_words as kept from failed
"""

OP6 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)
), counts as (select doc_id, s, count(*) as c from shingles group by doc_id, s
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, sum(least(x.c, y.c)) as o from counts x join counts y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2
), edges as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where o >= 0.8 * (p.n + q.n - o)
), ways as (select a, b from edges union all select b, a from edges
), reached as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, w.b from reached r join ways w on w.a = r.b
), classes as (select a as doc_id, min(b) as class_id from reached group by a
), firsts as (select text, min(doc_id) as first_id from documents where text is not null group by text)
select doc_id, class_id, case when s.n is null then doc_id else first_id end as first_id, class_id = doc_id as kept
from documents d join classes using (doc_id) left join sizes s using (doc_id) left join firsts f on f.text = d.text
"""



def _op7() -> str:
    joined = r"array_to_string(list_filter(string_split(lower(part), chr(10)), lambda x: not regexp_matches(x, '^\s*(copyright\b|\(c\)|©|all rights reserved\b).*')), chr(10))"
    joined = f"replace(regexp_replace({joined}, '(?m){_licences.LIST_MARK}', '', 'g'), chr(10), ' ')"
    for a, b in _licences.SPELLINGS.items():
        joined = f"regexp_replace({joined}, '\\b{a}\\b', '{b}', 'g')"
    values = ", ".join(f"('{d}', '{s}')" for d, s in sorted(_licences.known_digests().items()))
    return rf"""
with known(digest, spdx) as (values {values}
), units as (
  select doc_id, true as whole, text as part from documents where text is not null
  union all
  select doc_id, false, unnest(string_split(text, chr(10))) from documents where text is not null
), hits as (
  select doc_id, whole, spdx from units join known on digest = sha256(trim(regexp_replace({joined}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')))
), found as (
  select doc_id, min(spdx) filter (whole) as licence, count(*) filter (not whole) as n_lines, array_to_string(list_sort(list(distinct spdx)), ',') as licences
  from hits group by doc_id
)
select d.doc_id, licence, coalesce(n_lines, 0)::bigint as n_lines, coalesce(licences, '') as licences from documents d left join found using (doc_id)
"""


OP10 = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select item_id, w, least(13, len(w)) as size, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)
), doc_windows as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from item_windows) where len(w) >= size)
), hits as (
  select doc_id, item_id, i, d.size from doc_windows d join item_windows m on m.g = d.g and m.size = d.size
), covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hits)) group by doc_id
), per_doc as (
  select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(p.n, 0)::bigint as n_items, sha256(coalesce(p.ids, '')) as items_sha256,
  coalesce(c.n, 0) > 0 and 20 * coalesce(c.n, 0) >= len(w) as contaminated
from docs d left join covered c using (doc_id) left join per_doc p using (doc_id)
"""

#: CRC-32 of a decimal number's digits, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_transform(string_split({0}::varchar, ''), lambda c: ascii(c)::bigint), lambda s, c: list_reduce(list_concat([xor(s, c)], range(0, 8)), lambda t, i: case when t & 1 = 1 then xor(t >> 1, 3988292384) else t >> 1 end), 4294967295))"


def _op13(levels: int = 8, top: int = 4) -> str:
    """``levels`` of each language's tree (16.7 million leaves), ``top`` of the tree over their roots."""
    item = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    row = lambda text: f"sha256({' || '.join(map(item, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def grow(name: str, n: int) -> str:
        """Node tables ``name``0, 1, ... and the runs that were hashed to get there."""
        out = ""
        for k in range(n):
            out += f"""
), {name}{k}m as materialized (select t from {name}{k} group by t having count(*) > 1
), {name}{k}r as materialized (select t, i // 8 as i, string_agg(d, '' order by i) as run from {name}{k} where t in (select t from {name}{k}m) group by t, i // 8
), {name}{k + 1} as materialized (select t, i, sha256(run) as d from {name}{k}r union all select t, i, d from {name}{k} where t not in (select t from {name}{k}m)"""
        return out

    def climb(source: str, name: str, n: int) -> str:
        """The proof and the folded digest of every row of ``source`` (t, i, proof, acc), level by level."""
        out, last = "", source
        for k in range(n):
            cut = f"left(r.run, (64 * (x.i // {8**k} % 8))::int)", f"substr(r.run, (64 * (x.i // {8**k} % 8) + 65)::int)"
            out += f"""
), {name}p{k} as (select x.* replace (x.proof || coalesce({cut[0]} || {cut[1]}, '') as proof, case when r.run is null then x.acc else sha256({cut[0]} || x.acc || {cut[1]}) end as acc) from {last} x left join {name}{k}r r on r.t = x.t and r.i = x.i // {8 ** (k + 1)}"""
            last = f"{name}p{k}"
        return out

    return f"""
with rows as materialized (
  select doc_id, coalesce('=' || lang, '') as t, {row("text")} as leaf, case when {CRC32.format("doc_id")} % 3 = 0 then {row(small)} else {row("text")} end as shown from documents
), placed as materialized (select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as i from rows
), a0 as (select t, i, leaf as d from placed{grow("a", levels)}
), b0 as (select 0 as t, row_number() over (order by t) - 1 as i, d, t as name from a{levels}{grow("b", top)}
), x0 as (select *, '' as proof, shown as acc from placed{climb("x0", "a", levels)}
), y0 as (select x.doc_id, x.leaf, x.proof, x.acc, 0 as t, b.i, b.d as subroot from ap{levels - 1} x join b0 b on b.name = x.t{climb("y0", "b", top)}
)
select doc_id, leaf, subroot, (select d from b{top}) as root, sha256(proof) as proof_sha256, acc as folded_root, acc = (select d from b{top}) as verified from bp{top - 1}
"""


ORACLES = {"op1_line_dedup": OP1, "op2_quality_rules": OP2, "op6_bagminhash": OP6, "op7_licences": _op7(), "op10_winnowing": OP10, "op13_merkle_manifest": _op13()}
