"""Exact dedup: texts already seen are found in minimal perfect hashes of their digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import mix
from loregraph.session import cut_lineage, ship, shuffle_width

# Digests of a shard, about; a shard is one row of the index.
SHARD = 1 << 15
# Bits of a level for each digest that is left.
ROOM = 2
GOLDEN = 0x9E3779B97F4A7C15
INDEX = (
    "shard long, level_bits array<long>, bits binary, digests binary, "
    "keep_ids array<long>, keep_rows array<long>, copies array<long>"
)
FOUND = "digest binary, keep_id long, keep_row long, group_size long, seen boolean"


class PerfectHash:
    """Numbers n distinct digests from 0 to n - 1, in about three bits each.

    Each level is a field of bits.  A digest that is alone at its place in a
    level sets the bit there, the others go on to the next level; a digest's
    number is the number of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, packed: bytes):
        self.sizes = sizes
        self.offset = np.cumsum(sizes) - sizes
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(sizes.sum())).astype(bool)
        self.before = np.cumsum(self.bits) - self.bits

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * GOLDEN & (1 << 64) - 1)
        return (mix(words[:, level % 4] ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bits of each level and the levels' bits for digests as rows of four 64-bit words."""
        sizes: list[int] = []
        fields = [np.zeros(0, bool)]
        while len(words):
            size = max(64, ROOM * len(words))
            at = cls.place(words, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            fields.append(alone)
            words = words[~alone[at]]
        return np.array(sizes, np.int64), np.packbits(np.concatenate(fields)).tobytes()

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each digest; of one that was not numbered -1 or that of another."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.offset[level] + self.place(words[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return out


def as_words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def _index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash, and in its slots digest, winner and number of copies."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(source):
            rows = pa.Table.from_batches([p for _, p in parts])
            digests = b"".join(rows["digest"].to_pylist())
            words = as_words(digests)
            sizes, bits = PerfectHash.build(words)
            order = np.argsort(PerfectHash(sizes, bits).numbers(words))
            slots = rows.take(pa.array(order))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": [shard],
                    "level_bits": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                    "bits": pa.array([bits], pa.binary()),
                    "digests": pa.array([words[order].tobytes()], pa.binary()),
                    **{
                        name: pa.array([slots[c].to_pylist()], pa.list_(pa.int64()))
                        for name, c in (("keep_ids", "id"), ("keep_rows", "row"), ("copies", "n"))
                    },
                }
            )

    dealt = groups.withColumn("shard", _shard(shards)).withColumn("part", F.lit(1))
    dealt = dealt.select("shard", "part", "digest", "id", "row", "n")
    dealt = dealt.repartition(shuffle_width(groups.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, INDEX)


def _shard(shards: int) -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit(shards - 1))


def _by_shard(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, pa.RecordBatch]]]]:
    """Shards of rows that come in their order, each as slices (part, rows) of one part."""

    def slices() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in source:
            shard, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
            edge = [0, *cut.tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b > a:
                    yield int(shard[a]), int(part[a]), batch.slice(a, b - a)

    ahead = slices()
    held = next(ahead, None)

    def of(shard: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        nonlocal held
        while held is not None and held[0] == shard:
            now, held = held, next(ahead, None)
            yield now[1:]

    while held is not None:
        shard = held[0]
        rows = of(shard)
        yield shard, rows
        for _ in rows:
            pass


class Slots:
    """A shard of the index while arrivals are looked up in it."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(np.array(row["level_bits"], np.int64), row["bits"])
        self.words = as_words(row["digests"])
        self.ids, self.rows, self.copies = row["keep_ids"], row["keep_rows"], row["copies"]

    def join(self, words: np.ndarray, ids: list, rows: list, copies: list) -> np.ndarray:
        """Put arrivals into the slots of their digests; which ones have a slot."""
        slot = self.hash.numbers(words)
        known = slot >= 0
        known[known] = (self.words[slot[known]] == words[known]).all(1)
        for k in np.flatnonzero(known).tolist():
            s = int(slot[k])
            ours, theirs = (self.ids[s], self.rows[s]), (ids[k], rows[k])
            if _rank(*theirs) > _rank(*ours):
                self.ids[s], self.rows[s] = theirs
            self.copies[s] += copies[k]
        return known


def _rank(doc_id: int | None, row: int) -> tuple:
    return doc_id is not None, doc_id or 0, row


def _lookup(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Every distinct digest of index and arrivals with its winner."""
    asked = arrivals.withColumn("shard", _shard(shards)).withColumn("part", F.lit(1))
    both = index.withColumn("part", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    names = ("level_bits", "bits", "digests", "keep_ids", "keep_rows", "copies", "digest", "id", "row", "n")
    both = both.select("shard", "part", *names).repartition(shuffle_width(arrivals.sparkSession), "shard")

    def out(digests: list, ids: list, rows: list, copies: list, seen: bool) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = (digests, ids, rows, copies, [seen] * len(digests))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["digest", "keep_id", "keep_row", "group_size", "seen"],
        )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_shard(source):
            slots = None
            for part, rows in parts:
                if part == 0:
                    slots = Slots(rows.slice(0, 1).to_pylist()[0])
                    continue
                digests, ids, row, n = (rows.column(k).to_pylist() for k in range(8, 12))
                known = np.zeros(len(ids), bool)
                if slots is not None:
                    known = slots.join(as_words(b"".join(digests)), ids, row, n)
                new = np.flatnonzero(~known).tolist()
                yield out(*[[c[k] for k in new] for c in (digests, ids, row, n)], False)
            if slots is not None:
                every = slots.words.tobytes()
                digests = [every[i : i + 32] for i in range(0, len(every), 32)]
                yield out(digests, slots.ids, slots.rows, slots.copies, True)

    return both.sortWithinPartitions("shard", "part").mapInArrow(run, FOUND)


def exact_dedup(docs: DataFrame, seen: Column) -> DataFrame:
    """Which row of equal texts stays, for rows seen before and new ones.

    ``seen`` says of each row whether it belongs to the history (null: no).
    One row per row of ``docs``: doc_id, keep_id (largest doc_id of the rows
    with the same text), group_size, kept, text_sha256 (lower-case hex), seen
    (whether the history has the text).

    The history's distinct SHA-256 digests are numbered by minimal perfect
    hashes, one per shard of about ``SHARD`` digests; slots hold the whole
    digest, the winner's id and row, and its copies.  Arrivals, one row per
    distinct digest, are looked up in the shard of their digest; all 32 bytes
    must agree.  Digests without a slot form groups of their own.

    Null texts count as empty.  Null ids are smaller than all others; of rows
    that share text and largest id exactly one stays.  An empty table, an
    empty history or one without arrivals are no special cases, and columns
    other than doc_id, text and those of ``seen`` are ignored.  Copies are
    counted in each task before they are shuffled; no text is shuffled, and
    the rows' join with their groups may be split where one digest is hot.
    """
    ship(docs.sparkSession)
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(seen, F.lit(False)).alias("past")
    )
    rows = known.select(
        "doc_id",
        "past",
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut_lineage(rows)
    groups = rows.groupBy("digest", "past").agg(
        F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("n")
    )
    groups = groups.select("digest", "past", F.col("last.doc_id").alias("id"), F.col("last.row").alias("row"), "n")
    groups = cut_lineage(groups)
    history = groups.filter("past").drop("past")
    shards = 1 << (max(0, history.count() - 1) // SHARD).bit_length()
    index = cut_lineage(_index(history, shards))
    found = cut_lineage(_lookup(groups.filter("not past").drop("past"), index, shards))
    return rows.join(found, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seen",
    )


EXACT_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
