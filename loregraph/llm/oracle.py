"""The operators that SQL can express, in SQL over the same tables."""

from loregraph.llm.chat import CHAT_SQL
from loregraph.llm.exact import EXACT_SQL
from loregraph.llm.oracle_conversations import REPAIR_SQL, TRIE_SQL

# Pairs that share a shingle, their overlaps, links, and the smallest id reached.
JACCARD_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, case
    when len(w) = 0 then []
    when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  end as g from d),
x as (select doc_id, unnest(g) as t from s),
n as (select doc_id, len(g) as n from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (
  select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b
  where 100 * p.c >= 90 * (na.n + nb.n - p.c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (
  select doc_id, doc_id from n
  union
  select r.doc_id, e.b from r join e on e.a = r.root)
select n.doc_id, n.n as n_shingles, min(r.root) as component_id
from n join r on r.doc_id = n.doc_id group by 1, 2
"""

ORACLE = {
    "op3_chat_format": CHAT_SQL,
    "op10_ngram_jaccard_join": JACCARD_SQL,
    "op11_exact_dedup": EXACT_SQL,
    "op12_conversation_repair": REPAIR_SQL,
    "op13_conversation_trie": TRIE_SQL,
}
