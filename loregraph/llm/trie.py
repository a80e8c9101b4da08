"""Prefix trie of conversations: adaptive radix trees over turn ids, joined across tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.session import cut_lineage, ship, shuffle_width

# Bytes of a turn's id.
TURN = 16
NO_CHILD = 0xFF


class Node:
    """Inner node or leaf of an adaptive radix tree.

    ``path`` holds the compressed bytes from the parent's branching byte on;
    ``words`` those of the turns that end within it.  Up to 4 and 16 children
    are kept beside a list of their bytes, up to 48 behind an index of 256
    bytes, more in a field of 256.
    """

    __slots__ = ("path", "words", "ends", "keys", "kids", "layout")

    def __init__(self, path: bytes, words: list[int]):
        self.path, self.words = path, words
        self.ends: list[int] = []
        self.layout = 4
        self.keys = bytearray()
        self.kids: list[Node | None] = []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.kids[at] if at != NO_CHILD else None
        return self.kids[byte]

    def add(self, byte: int, node: Node) -> None:
        if self.layout <= 16 and len(self.keys) == self.layout:
            self._grow()
        elif self.layout == 48 and len(self.kids) == 48:
            self._grow()
        if self.layout <= 16:
            self.keys.append(byte)
            self.kids.append(node)
        elif self.layout == 48:
            self.keys[byte] = len(self.kids)
            self.kids.append(node)
        else:
            self.kids[byte] = node

    def swap(self, byte: int, node: Node) -> None:
        """Put ``node`` in the place of a child."""
        if self.layout <= 16:
            self.kids[self.keys.find(byte)] = node
        elif self.layout == 48:
            self.kids[self.keys[byte]] = node
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray([NO_CHILD]) * 256
            for at, byte in enumerate(self.keys):
                index[byte] = at
            self.keys, self.layout = index, 48
        else:
            field: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.keys):
                if at != NO_CHILD:
                    field[byte] = self.kids[at]
            self.keys, self.kids, self.layout = bytearray(), field, 256

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.layout <= 16:
            return [self.kids[at] for at in sorted(range(len(self.keys)), key=self.keys.__getitem__)]
        if self.layout == 48:
            return [self.kids[at] for at in self.keys if at != NO_CHILD]
        return [kid for kid in self.kids if kid is not None]


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


class Tree:
    """Conversations under the ids of their turns."""

    def __init__(self):
        self.root = Node(b"", [])

    def insert(self, key: bytes, words: list[int], conv_id: int) -> None:
        """``key``: 16 bytes a turn; ``words``: those of each turn."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.child(key[at])
            if kid is None:
                leaf = Node(key[at:], words[at // TURN :])
                leaf.ends.append(conv_id)
                node.add(key[at], leaf)
                return
            same = shared_length(kid.path, key[at : at + len(kid.path)])
            if same < len(kid.path):
                # Turns that end at or before the cut stay above it.
                turns = (at + same) // TURN - at // TURN
                upper = Node(kid.path[:same], kid.words[:turns])
                kid.path, kid.words = kid.path[same:], kid.words[turns:]
                upper.add(kid.path[0], kid)
                node.swap(key[at], upper)
                kid = upper
            node, at = kid, at + same
        node.ends.append(conv_id)


def name_of(above: bytes, turn: bytes) -> bytes:
    """Names a sequence of turns by that before the last one and the last one's id."""
    return hashlib.sha256(above + turn).digest()[:TURN]


class Seam:
    """What a task knows of the keys before and after its own.

    ``before`` and ``after``: turns that its first (last) key shares with the
    last (first) key of its neighbour; ``goes_on``: that one has turns beyond
    the last key here; ``equal``: it is the last key here.
    """

    def __init__(self, before: int = -1, after: int = -1, goes_on: bool = False, equal: bool = False):
        self.before, self.after, self.goes_on, self.equal = before, after, goes_on, equal


FIELDS = {
    "kind": pa.int32(),
    "name": pa.binary(),
    "parent": pa.binary(),
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
}
WHOLE, PART, END = range(3)
NODES = (
    "kind int, name binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def ends_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


class Found:
    """A node of the trie on the way up: its counts so far."""

    __slots__ = (
        *("name", "parent", "depth", "words", "new", "part", "last"),
        *("ends", "least", "n", "kids", "leaves", "saved", "below"),
    )

    def __init__(
        self, name: bytes, parent: bytes | None, depth: int, words: int, new: bool, part: bool, last: bool
    ):
        self.name, self.parent, self.depth, self.words = name, parent, depth, words
        self.new, self.part, self.last = new, part, last
        self.ends: list[int] = []
        self.least: int | None = None
        self.n = self.kids = self.leaves = self.saved = 0
        self.below: list[Found] = []


def walk(tree: Tree, seam: Seam, first: bytes, last: bytes) -> Iterator[dict]:
    """Rows for the nodes at turn-aligned depths, from the deepest up.

    A node that neighbours share is a PART: its counts are those of what is
    new in this task, so that parts add up.  Saved tokens are kept as words of
    all members less those of each node once, which adds up as well.
    """
    first_turns, last_turns = len(first) // TURN, len(last) // TURN
    shared = max(seam.before, seam.after) >= 0
    root = Found(hashlib.sha256(b"").digest()[:TURN], None, 0, 0, seam.before < 0, shared, not last)
    root.ends = tree.root.ends
    # (tree node or None to close, trie node above, bytes of a turn so far, on first path, on last path)
    todo: list[tuple] = [(None, root, b"", False, False)]
    todo += [(kid, root, b"", True, True) for kid in reversed(tree.root.children())]
    while todo:
        node, above, held, on_first, on_last = todo.pop()
        if node is None:
            yield from _closed(above, seam)
            continue
        path, used = held + node.path, 0
        for words in node.words:
            turn = path[used : used + TURN]
            used += TURN
            depth = above.depth + 1
            on_first = on_first and depth <= first_turns and first[(depth - 1) * TURN : depth * TURN] == turn
            on_last = on_last and depth <= last_turns and last[(depth - 1) * TURN : depth * TURN] == turn
            old = on_first and depth <= seam.before
            part = old or (on_last and depth <= seam.after)
            ends_task = on_last and depth == last_turns
            found = Found(name_of(above.name, turn), above.name, depth, words, not old, part, ends_task)
            above.below.append(found)
            todo.append((None, found, b"", False, False))
            above = found
        if used == len(path):
            above.ends = node.ends
        todo += [(kid, above, path[used:], on_first, on_last) for kid in reversed(node.children())]


def _closed(found: Found, seam: Seam) -> Iterator[dict]:
    """Rows of the children of a node all of whose subtree is known; of the root itself as well."""
    n = len(found.ends) + sum(k.n for k in found.below)
    ids = [*found.ends[:1], *[k.least for k in found.below if k.least is not None]]
    ids += found.ends[1:]
    found.n, found.least = n, min(ids, default=None)
    found.kids = sum(k.new for k in found.below)
    # The task that has the last key of an end knows whether it goes on.
    alone = bool(found.ends) and not found.below and not (found.last and (seam.goes_on or seam.equal))
    found.leaves = alone + sum(k.leaves for k in found.below)
    found.saved = found.words * (n - found.new) + sum(k.saved for k in found.below)
    for kid in found.below:
        yield from _rows(kid, found)
    found.below = []
    if found.parent is None:
        yield from _rows(found, None)


def _rows(found: Found, above: Found | None) -> Iterator[dict]:
    yield {
        "kind": PART if found.part else WHOLE,
        "name": found.name if found.part else None,
        "parent": above.name if above is not None and above.part else None,
        "conv_id": found.least,
        "depth": found.depth,
        "parent_conv_id": above.least if above is not None and not above.part else None,
        "n_convs": found.n,
        "n_children": found.kids,
        "n_leaves": found.leaves,
        "saved_tokens": found.saved,
        "ends_sha256": None if found.part else ends_hash(found.ends),
    }
    if found.part:
        for conv_id in found.ends:
            yield {**dict.fromkeys(FIELDS), "kind": END, "name": found.name, "conv_id": conv_id}


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: id (hexadecimal) and words of each turn in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.substring(text, 1, 64).alias("head"),
            F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 2 * TURN).alias("id"),
            F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id, turns: the first turns of each group's first conversation, then the conversation's own rest."""
    own = cut_lineage(_turns(conversations))
    own = own.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int"))
    own = own.withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
    heads = own.filter("conv_id = base").select("base", F.slice("turns", 1, most).alias("head"))
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _keys(conversations: DataFrame) -> DataFrame:
    """conv_id, key, words, part: keys in ranges of their order, so that shared beginnings may be split."""
    joined = F.array_join(F.transform("turns", lambda x: x["id"]), "")
    keys = conversations.select("conv_id", F.unhex(joined).alias("key"), F.col("turns.words").alias("words"))
    dealt = keys.repartitionByRange(shuffle_width(conversations.sparkSession), "key", "conv_id")
    return cut_lineage(dealt.withColumn("part", F.spark_partition_id()))


def _seams(keys: DataFrame) -> dict[int, Seam]:
    """For each part what it shares with its neighbours: four numbers each, found in one pass over first and last keys."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in source:
            for row in batch.to_pylist():
                if before is not None:
                    a, b = before["last"], row["first"]
                    turns = shared_length(a, b) // TURN
                    more = turns * TURN == len(a)
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "before": before["part"],
                                "after": row["part"],
                                "turns": turns,
                                "goes_on": more and len(b) > len(a),
                                "equal": a == b,
                            }
                        ]
                    )
                before = row

    edges = keys.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edges = edges.repartition(1).sortWithinPartitions("part")
    found: dict[int, Seam] = {}
    for r in edges.mapInArrow(run, "before long, after long, turns long, goes_on boolean, equal boolean").collect():
        left = found.setdefault(r["before"], Seam())
        left.after, left.goes_on, left.equal = r["turns"], r["goes_on"], r["equal"]
        found.setdefault(r["after"], Seam()).before = r["turns"]
    return found


def _trees(keys: DataFrame, seams: dict[int, Seam]) -> DataFrame:
    """Nodes of the tree of each part."""
    schema = pa.schema(list(FIELDS.items()))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, first, last = None, Tree(), b"", b""

        def rows() -> Iterator[pa.RecordBatch]:
            out = []
            for row in walk(tree, seams.get(part) or Seam(), first, last):
                out.append(row)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

        for batch in source:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield from rows()
                    part, tree, first = row["part"], Tree(), row["key"]
                last = row["key"]
                tree.insert(row["key"], row["words"], row["conv_id"])
        if part is not None:
            yield from rows()

    dealt = keys.select("part", "key", "words", "conv_id").repartition(shuffle_width(keys.sparkSession), "part")
    return dealt.sortWithinPartitions("part", "key", "conv_id").mapInArrow(run, NODES)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """name, ends_sha256: conversations that end at nodes in several tasks, read in order and never held."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in source:
            done = []
            for name, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != now:
                    if now is not None:
                        done.append({"name": now, "ends_sha256": digest.hexdigest()})
                    now, digest = name, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(b",%d" % conv_id)
            yield pa.RecordBatch.from_pylist(done, out)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"name": now, "ends_sha256": digest.hexdigest()}], out)

    out = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
    dealt = ends.select("name", "conv_id").repartition(shuffle_width(ends.sparkSession), "name")
    return dealt.sortWithinPartitions("name", "conv_id").mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turns as struct<id, words> in order).

    A node is a distinct sequence of first turns: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over
    its subtree, members but one times words of the last turn), ends_sha256
    (of the ids of those that end there).  The root has depth 0; without
    conversations there is no node.

    Keys are 16 bytes of each turn's SHA-256.  They are dealt by ranges of
    their order, so that a hot first turn, a hot beginning or copies of one
    conversation spread over tasks, each of which builds an adaptive radix
    tree.  Only nodes on the way to a task's first or last key can lie in
    several tasks; their counts are made to add up, and they are summed by
    name.  A conversation is one row of 20 bytes a turn; texts are read once
    and not shuffled.
    """
    keys = _keys(conversations)
    nodes = cut_lineage(_trees(keys, _seams(keys)))
    parts = nodes.filter(F.col("kind") == PART).groupBy("name").agg(
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "parent")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    parts = cut_lineage(parts)
    none = F.sha2(F.lit("").cast("binary"), 256)
    hashes = _end_hashes(nodes.filter(F.col("kind") == END))
    shared = parts.join(hashes, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    whole = nodes.filter(F.col("kind") == WHOLE)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    above = parts.select(F.col("name").alias("parent"), F.col("conv_id").alias("above"))
    every = whole.select("parent", *columns).unionByName(
        shared.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent", *columns)
    )
    joined = every.join(above, "parent", "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations as ``rebuilt`` gives them.

    Turns are ordered by number (nulls first), then role, first 64 characters
    and hash of the text.  Null roles and texts count as empty, repeated rows
    are turns like others, rows without conv_id are left out, an empty table
    gives an empty result, and columns other than conv_id, turn, role and text
    are ignored.
    """
    ship(conversations.sparkSession)
    return prefix_trie(cut_lineage(rebuilt(conversations)))
