"""Chat formatting: cumulative snapshots collapse to maximal conversations, then rendering.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.session import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, and two 64-bit hashes of each prefix.

    A turn's hash covers its place, role and text, so the exclusive or of the
    hashes up to a turn names that prefix; two of them make 128 bits.
    """
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = c.withColumn("place", F.row_number().over(order))
    return placed.withColumn("h1", F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far)).withColumn(
        "h2", F.bit_xor(F.xxhash64("text", "place", "role", F.lit("second"))).over(so_far)
    )


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: the turns of each conversation in one text."""
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    return (
        turns.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"),
        )
        .select("conv_id", "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))
    )


def _last(turns: DataFrame) -> DataFrame:
    """One row per conversation: its length and the hashes of the whole."""
    by_place = lambda c: F.max_by(c, "place").alias(c)
    return turns.groupBy("conv_id").agg(F.max("place").alias("place"), by_place("h1"), by_place("h2"))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as rendered text: conv_id, n_turns, n_copies, rendered.

    A conversation whose turns (role and text, in order) are the beginning of a
    longer one was logged before that one went on, and is dropped; of equal
    ones the smallest conv_id stays, and n_copies counts them.  Turns are
    ordered by number, role and text; repeated rows are turns like others; null
    roles and texts count as empty, rows without conv_id are left out, and an
    empty table gives an empty result.  Columns other than conv_id, turn, role
    and text are ignored.

    Prefixes that many conversations share are one row per task before they
    are shuffled; only conversations that stay are rendered.
    """
    turns = cut_lineage(_turns(conversations).select("conv_id", "place", "role", "text", "h1", "h2"))
    whole = _last(turns.select("conv_id", "place", "h1", "h2"))
    ends = (
        whole.groupBy("place", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
        .select("conv_id", "n_copies", "place", "h1", "h2")
    )
    # Prefixes that go on: all but the last place of a conversation.
    inner = (
        turns.select("conv_id", "place", "h1", "h2")
        .join(whole.select("conv_id", F.col("place").alias("n")), "conv_id")
        .filter("place < n")
        .select("place", "h1", "h2")
        .distinct()
    )
    kept = ends.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", "n_copies")
    return (
        rendered(turns.join(kept.select("conv_id"), "conv_id", "left_semi"))
        .join(kept, "conv_id")
        .select("conv_id", "n_turns", "n_copies", "rendered")
    )


CHAT_SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (
  select conv_id, count(*) as n_turns,
         list(struct_pack(r := role, x := text) order by place) as turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by place) as rendered
  from t group by conv_id),
p as (
  select distinct list_slice(turns, 1, k) as turns
  from (select turns, unnest(range(1, n_turns)) as k from c)),
e as (select turns, min(conv_id) as conv_id, count(*) as n_copies from c group by turns)
select c.conv_id, c.n_turns, e.n_copies, c.rendered
from e join c on c.conv_id = e.conv_id
where not exists (select 1 from p where p.turns = e.turns)
"""
