"""Conversation repair and the prefix trie in SQL."""

# crc32 of the text {0}, with its table of 256 entries in t.v.
CRC_TABLE = """crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8),
    lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, i)) as v)"""


def crc32(text: str) -> str:
    return (
        f"xor(4294967295::bigint, list_reduce(list_transform(range(1, strlen({text}) + 1), "
        f"lambda place: ascii(({text})[place])::bigint), lambda c, b: "
        f"xor(c // 256, v[1 + (xor(c, b) & 255)]), 4294967295::bigint))"
    )


NEVER = 1_000_000_000
FOLLOWS = (2, 2, 3, 2)
KEEPS = ("when i = 's' then v1 when i = 'u' then v2", "when i = 'u' then v2", "when i = 'a' then v3", "when i = 'u' then v2")


def _step(cost: str, letter: str, state: str) -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := '{letter}' || {state}.a)"


def _row(state: int) -> str:
    """Cheapest way over a row from a state on, turns inserted behind it included."""
    never = f"struct_pack(c := {NEVER}::bigint, a := '')"
    keep = f"case {KEEPS[state]} else {never} end"
    kept = (
        f"struct_pack(c := ({keep}).c + case when fault = 3 then 5 else 0 end, a := 'K' || ({keep}).a)"
    )
    reroled = _step("1 + case when fault = 3 then 5 else 0 end", "R", f"v{FOLLOWS[state]}")
    deleted = _step("2", "D", f"v{state}")
    return (
        f"case when fault in (1, 2) then {deleted} else list_sort([{deleted}, {kept}, {reroled}])[1] end as w{state}"
    )


def _inserts(state: int) -> str:
    ways = [f"w{state}", _step("5", "I", f"w{FOLLOWS[state]}")]
    if state < 2:
        ways.append(_step("10", "II", "w3"))
    return f"list_sort([{', '.join(ways)}])[1] as v{state}"


REPAIR_SQL = rf"""
with recursive {CRC_TABLE},
raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations),
hit as (select raw.*, {crc32('k')} % 20 as h from raw, crc_table),
dam as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
         case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when h = 3 then [0, 1] else [0] end) as copy
  from hit where h <> 0),
pos as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as p,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen
  from dam),
f as (
  select *, role[1] as i, lag(role[1]) over (partition by conv_id order by p) || role[1] as pair,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when seen > 1 then 2
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault
  from pos),
counts as (
  select conv_id, count(*) as n,
         coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
         count(*) filter (fault = 3) as truncated,
         count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id),
back as (
  select conv_id, n + 1 as p, struct_pack(c := 0::bigint, a := '') as v0, struct_pack(c := 10::bigint, a := 'II') as v1,
         struct_pack(c := 5::bigint, a := 'I') as v2, struct_pack(c := 0::bigint, a := '') as v3
  from counts
  union all
  select conv_id, p, {', '.join(map(_inserts, range(4)))}
  from (
    select f.conv_id, f.p, {', '.join(map(_row, range(4)))}
    from back join f on f.conv_id is not distinct from back.conv_id and f.p = back.p - 1)),
plan as (select conv_id, v0.c as cost, v0.a as audit from back where p = 1),
done as (
  select conv_id, audit, 1 as k, 0 as p, 0 as state, []::varchar[] as lines from plan
  union all
  select d.conv_id, d.audit, d.k + 1, d.p + case when d.audit[d.k] = 'I' then 0 else 1 end,
         case when d.audit[d.k] = 'D' then d.state
              when d.audit[d.k] = 'K' then case f.i when 's' then 1 when 'u' then 2 else 3 end
              when d.state = 2 then 3 else 2 end,
         case d.audit[d.k] when 'D' then d.lines when 'K' then list_append(d.lines, f.role || ':' || f.text)
              else list_append(d.lines, case when d.state = 2 then 'assistant:' else 'user:' end ||
                               case when d.audit[d.k] = 'R' then f.text else '' end) end
  from done d left join f on f.conv_id is not distinct from d.conv_id and f.p = d.p + 1
  where d.k <= length(d.audit)),
fixed as (
  select conv_id, audit, sha256(array_to_string(lines, chr(10))) as repaired_sha256
  from done where k = length(audit) + 1)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate,
       coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal, coalesce(p.cost, 0) as cost,
       coalesce(p.audit, '') as audit, coalesce(x.repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join plan p on p.conv_id is not distinct from o.conv_id
left join fixed x on x.conv_id is not distinct from o.conv_id
"""

TRIE_SQL = rf"""
with {CRC_TABLE},
own as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
                       order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
h as (select conv_id, turns, conv_id::varchar as k from own),
cut as (select conv_id, turns, {crc32('k')} % 4 as h from h, crc_table),
built as (
  select c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), list_slice(c.turns, 1, 0)),
                                list_slice(c.turns, c.h + 1, greatest(len(c.turns), c.h))) as turns
  from cut c left join own b on b.conv_id = c.conv_id - c.conv_id % 20),
member as (
  select conv_id, len(turns) as n, d as depth, list_slice(turns, 1, d) as node,
         case when d > 0 then list_slice(turns, 1, d - 1) end as parent, turns[d].x as last
  from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from built)),
node as (
  select node, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256,
         (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')), 0) as saved
  from member group by node, depth),
child as (select parent as node, count(*) as n from node where depth > 0 group by parent),
full_node as (select node.*, coalesce(child.n, 0) as n_children from node left join child using (node)),
up as (
  select list_slice(node, 1, d) as node, saved, n_children = 0 as leaf
  from (select node, saved, n_children, unnest(range(0, depth + 1)) as d from full_node)),
total as (
  select node, sum(saved)::bigint as saved_tokens, count(*) filter (leaf) as n_leaves from up group by node)
select a.conv_id, a.depth, p.conv_id as parent_conv_id, a.n_convs, a.n_children, t.n_leaves, t.saved_tokens, a.ends_sha256
from full_node a join total t using (node) left join full_node p on a.parent = p.node
"""
