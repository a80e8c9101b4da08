"""Conversation structure repair: cheapest edits by a DP over big-integer weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.session import cut_lineage, ship, shuffle_width

# Rows of a conversation whose edits are weighed in one go, as a power of two.
FRAGMENT = 10
# Letters of the edits in ASCII order; 0 pads the end.
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
# Bits of a letter in a weight.
WIDTH = 3
MASK = (1 << WIDTH) - 1
# What was written last: nothing, a system, a user or an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# Where a turn of a role leads from each of them.
AFTER = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
# The only turn other than a system's that may follow, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NOTHING, ASSISTANT)
KEPT_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
SEEN = "[^\\x20\\x09-\\x0D]"
FRAGMENTS = (
    "conv_id long, part long, n long, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, first boolean, last boolean, "
    "weights array<struct<start: int, end: int, cost: long, letters: string>>"
)
PLANS = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = PLANS + ", repaired_sha256 string"


class Weight:
    """Weights of edit sequences of at most ``room`` letters as plain integers.

    The high digits are the cost; below them each letter has its place, the
    first one the highest, and places after the last letter are zero.  Of two
    weights the smaller one is cheaper or, at equal cost, first in ASCII order.
    """

    def __init__(self, room: int):
        self.bits = WIDTH * room
        self.below = (1 << self.bits) - 1

    def before(self, cost: int, letters: int, count: int, rest: int | None) -> int | None:
        """Weight of ``count`` letters in front of what ``rest`` weighs."""
        if rest is None:
            return None
        shift = WIDTH * count
        return (
            ((rest >> self.bits) + cost << self.bits)
            | (letters << self.bits - shift)
            | ((rest & self.below) >> shift)
        )

    def read(self, weight: int) -> tuple[int, str]:
        """Cost and letters."""
        digits = weight & self.below
        text = f"{digits:0{self.bits // WIDTH}o}".rstrip("0") if self.bits else ""
        return weight >> self.bits, text.translate(SPELL)


SPELL = {ord(str(k)): c for k, c in enumerate(LETTERS) if k}
DIGITS = {ord(c): str(k) for k, c in enumerate(LETTERS) if k}


def least(*found: int | None) -> int | None:
    some = [x for x in found if x is not None]
    return min(some) if some else None


def with_inserts(space: Weight, values: list[int | None]) -> list[int | None]:
    """Weights from each state on if turns may be inserted first; two reach every state."""
    for _ in range(2):
        more = [space.before(INSERT_COST, INSERT, 1, values[NEXT[s]]) for s in range(4)]
        values = [least(v, m) for v, m in zip(values, more, strict=True)]
    return values


def weigh(rows: list[tuple[str, bool, bool]], starts: tuple, ends: list[tuple]) -> list[tuple]:
    """(start, end, cost, letters) of the cheapest edits of rows (role's initial, must go, truncated).

    ``ends``: sets of states in which edits may end; each gives a row under its
    first state.  Nodes are a row and a state, visited from the last row on.
    """
    space = Weight(len(rows) + (2 * len(rows) + 3 * INSERT_COST) // INSERT_COST)
    out = []
    for end in ends:
        after = with_inserts(space, [0 if s in end else None for s in range(4)])
        for initial, gone, truncated in reversed(rows):
            extra = TRUNCATED_COST if truncated else 0
            lead = AFTER.get(initial, (None,) * 4)
            now = []
            for state in range(4):
                found = [space.before(DELETE_COST, DELETE, 1, after[state])]
                if not gone:
                    if lead[state] is not None:
                        found.append(space.before(KEPT_COST + extra, KEEP, 1, after[lead[state]]))
                    found.append(space.before(REROLE_COST + extra, REROLE, 1, after[NEXT[state]]))
                now.append(least(*found))
            after = with_inserts(space, now)
        for start in starts:
            if after[start] is not None:
                out.append((start, end[0], *space.read(after[start])))
    return out


def chain(parts: list[list[tuple]]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits over fragments in order."""
    room = sum(max((len(w["letters"]) for w in p), default=0) for p in parts)
    space = Weight(room)
    after: list[int | None] = [0 if s in ENDS else None for s in range(4)]
    for part in reversed(parts):
        now: list[int | None] = [None] * 4
        for w in part:
            letters = int(w["letters"].translate(DIGITS) or "0", 8)
            value = space.before(w["cost"], letters, len(w["letters"]), after[w["end"]])
            now[w["start"]] = least(now[w["start"]], value)
        after = now
    return space.read(after[NOTHING])


def edited(rows: Iterator[tuple[str, str]], letters: str) -> Iterator[str]:
    """The repaired ``role:text`` lines of rows (role, text), one after the other."""
    state, at = NOTHING, 0

    def inserted() -> Iterator[str]:
        nonlocal state, at
        while letters[at : at + 1] == LETTERS[INSERT]:
            state, at = NEXT[state], at + 1
            yield f"{ROLES[state]}:"

    for role, text in rows:
        yield from inserted()
        letter, at = letters[at], at + 1
        if letter == LETTERS[KEEP]:
            state = AFTER[role[:1]][state]
            yield f"{role}:{text}"
        elif letter == LETTERS[REROLE]:
            state = NEXT[state]
            yield f"{ROLES[state]}:{text}"
    yield from inserted()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy after damage by the crc32 of ``conv_id:turn`` modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        blank("role").alias("role"),
        blank("text").alias("text"),
        F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20)).alias("hit"),
    ).filter("hit > 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _said() -> Column:
    """Names role and text of a conversation; length first, so that they cannot run together."""
    parts = (F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.col("role"))
    return F.unhex(F.sha2(F.concat_ws(":", *parts, F.col("text")), 256))


ORDER = ("turn", "role", "head", "said", "copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("said", _said())


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial, fault (1 blank, 2 duplicate, 3 truncated, 0 none), without texts.

    ``at`` rises with the order of the rows of a conversation.  Rows are dealt
    by ranges of that order, so a long conversation lies in several tasks.
    """
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    slim = _keyed(rows).select(
        "conv_id",
        *ORDER,
        F.substring("role", 1, 1).alias("initial"),
        F.when(~F.col("text").rlike(SEEN), 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("seems"),
    )
    width = shuffle_width(rows.sparkSession)
    placed = slim.repartitionByRange(width, "conv_id", "turn", "role", "head", "said")
    placed = placed.sortWithinPartitions("conv_id", *ORDER)
    placed = cut_lineage(
        placed.select("conv_id", "turn", "initial", "seems", "said", F.monotonically_increasing_id().alias("at"))
    )
    again = placed.groupBy("said").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    marked = placed.join(again.filter("n > 1").drop("n"), "said", "left")
    fault = F.when((F.col("seems") != 1) & (F.col("at") > F.col("first_at")), 2).otherwise(F.col("seems"))
    return marked.select("conv_id", "at", "turn", "initial", fault.alias("fault"))


def _fragments(faults: DataFrame) -> DataFrame:
    """Weights of each fragment of at most 1,024 rows, between the states it may begin and end in."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for row in batch.to_pylist():
                rows = row["rows"]
                initials = [r["initial"] for r in rows]
                pairs = [a + b for a, b in zip(initials[:-1], initials[1:], strict=True)]
                fault = [r["fault"] for r in rows]
                first, last = row["part"] == row["first_part"], row["part"] == row["last_part"]
                weights = weigh(
                    [(r["initial"], r["fault"] in (1, 2), r["fault"] == 3) for r in rows],
                    (NOTHING,) if first else (NOTHING, SYSTEM, USER, ASSISTANT),
                    [ENDS] if last else [(s,) for s in range(4)],
                )
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "part": row["part"],
                        "n": len(rows),
                        "blank": fault.count(1),
                        "duplicate": fault.count(2),
                        "truncated": fault.count(3),
                        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
                        "first_role": initials[0],
                        "last_role": initials[-1],
                        "first": first,
                        "last": last,
                        "weights": [
                            dict(zip(("start", "end", "cost", "letters"), w, strict=True)) for w in weights
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    weight = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
    names = ("conv_id", "part", "n", "blank", "duplicate", "truncated", "illegal")
    schema = pa.schema(
        [(n, pa.int64()) for n in names]
        + [("first_role", pa.string()), ("last_role", pa.string()), ("first", pa.bool_()), ("last", pa.bool_())]
        + [("weights", pa.list_(weight))]
    )
    part = F.shiftrightunsigned("at", FRAGMENT).alias("part")
    parts = faults.groupBy("conv_id", part).agg(
        F.sort_array(F.collect_list(F.struct("at", "initial", "fault"))).alias("rows")
    )
    spans = faults.groupBy("conv_id").agg(F.min(part).alias("first_part"), F.max(part).alias("last_part"))
    joined = parts.alias("p").join(spans.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    return joined.select("p.*", "first_part", "last_part").mapInArrow(run, FRAGMENTS)


def _plans(fragments: DataFrame) -> DataFrame:
    """Counts, cost and letters of each conversation."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for row in batch.to_pylist():
                parts = row["parts"]
                seams = [a["last_role"] + b["first_role"] for a, b in zip(parts[:-1], parts[1:], strict=True)]
                cost, audit = chain([p["weights"] for p in parts])
                found = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
                found["illegal"] += sum(s not in ("su", "ua", "au") for s in seams)
                out.append({"conv_id": row["conv_id"], **found, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema)

    names = ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([(n, pa.int64()) for n in names] + [("audit", pa.string())])
    fields = F.struct(*[c for c in fragments.columns if c not in ("conv_id", "first", "last", "n")])
    whole = fragments.groupBy("conv_id").agg(F.sort_array(F.collect_list(fields.alias("p")), asc=True).alias("parts"))
    return whole.mapInArrow(run, PLANS)


def _texts(rows: DataFrame, plans: DataFrame, with_text: bool) -> DataFrame:
    """Plans with the hash of each repaired conversation (and its text), written turn by turn."""
    schema = REPAIRED + (", repaired string" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, lines = None, iter(())
        ahead = (r for batch in source for r in batch.to_pylist())
        row = next(ahead, None)
        out: list[dict] = []

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal row
            row = next(ahead, None)
            while row is not None and row["kind"] == 1:
                yield row["role"], row["text"]
                row = next(ahead, None)

        while row is not None:
            plan = {n: row.get(n) for n in names}
            digest, held, first = hashlib.sha256(), [], True
            lines = edited(turns(), plan["audit"])
            for line in lines:
                digest.update(line.encode() if first else b"\n" + line.encode())
                first = False
                if with_text:
                    held.append(line)
            plan["repaired_sha256"] = digest.hexdigest()
            if with_text:
                plan["repaired"] = "\n".join(held)
            out.append(plan)
            if len(out) >= 1000 or with_text:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    strings = ("audit", "repaired_sha256", "repaired")
    kinds = pa.schema([(n, pa.string() if n in strings else pa.int64()) for n in names])
    turns = _keyed(rows).withColumn("kind", F.lit(1))
    both = plans.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    both = both.repartition(shuffle_width(rows.sparkSession), "conv_id")
    both = both.sortWithinPartitions("conv_id", "kind", *ORDER)
    return both.drop("head", "said", "turn", "copy").mapInArrow(run, schema)


def repair_conversations(
    rows: DataFrame, conversations: DataFrame | None = None, with_text: bool = False
) -> DataFrame:
    """The cheapest edits that give each conversation the roles ``(s?(ua)+)?``.

    ``rows``: conv_id, turn, role, text, copy.  ``conversations`` may name
    conversations (conv_id) of which no row is left.  One row per conversation:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (and ``repaired`` with ``with_text``).

    Keep costs 0, Rerole 1, Delete 2, Insert 5, and a truncated row that is not
    deleted 5 more; blank and duplicate rows must go.  A weight is one integer
    (``Weight``), so the smallest one is cheapest and, of those, first by its
    audit.  Long conversations are weighed in fragments of at most 1,024 rows
    for each pair of states before and after; two sequences of equal cost over
    the same rows are never prefixes of each other, so the best of fragments
    are parts of the best whole.

    Rows go by turn (nulls first), then role, first 64 characters and hash of
    text, then ``copy``.  Null roles and texts are one blank; an empty role or
    any initial but s, u, a fits nowhere and is reroled or deleted; rows without
    conv_id are a conversation of their own; repeated rows are duplicates; an
    empty table gives an empty result; other columns are ignored.

    Faults are found without the texts, which are shuffled once at the end.
    There the rows of a conversation stream through one task, as the hash of
    the whole is sequential; no task holds a conversation's texts unless they
    are asked for, but its audit (a letter a row) is one value.
    """
    ship(rows.sparkSession)
    faults = cut_lineage(_faults(rows.select("conv_id", "turn", "role", "text", "copy")))
    plans = _plans(cut_lineage(_fragments(faults)))
    fixed = _texts(rows.select("conv_id", "turn", "role", "text", "copy"), plans, with_text)
    turns = faults.select("conv_id", "turn").distinct().groupBy("conv_id")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    every = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long")).distinct()
    out = every.alias("e")
    for name, more in (("g", turns.agg(gaps)), ("f", fixed)):
        out = out.join(more.alias(name), F.col("e.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "e.conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ["gaps", *zero]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        *([F.coalesce("repaired", F.lit("")).alias("repaired")] if with_text else []),
    )
