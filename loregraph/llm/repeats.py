"""Removal of repeated byte strings: merged Burrows-Wheeler transforms of shards.

A string of ``LENGTH`` bytes is placed by its anchor, the smallest of the
hashes of its k-grams, so equal strings have equal anchors.  Consecutive
strings of a text with the same anchor form a context.  Anchors that occur
once are dropped, contexts that occur twice are repeated as a whole, and what
is left, contexts that share an anchor but not all their bytes, is compared
byte by byte: each shard's contexts have a Burrows-Wheeler transform, and the
transforms are merged by refining their interleave one symbol at a time,
without sorting the suffixes of all shards again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, mix, raw, texts
from loregraph.llm.jaccard import _by_bucket, _dealt, stable_order
from loregraph.session import cut_lineage, shuffle_width

LENGTH, GRAM, SYMBOL = 200, 64, 8
# Bytes worked on at once; a longer text is cut at multiples of this.
PIECE = 2 << 20
# Bytes of contexts whose transforms are merged at a time (whole anchors).
MERGE_BYTES = 256 << 10
PLACE = np.uint64((1 << 28) - 1)
ODD = 0x9E3779B97F4A7C15
ALL, SHIP, BOTH = 1, 2, 3


class Hasher:
    """Hashes of substrings from sums over prefixes, modulo 2^64."""

    value = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 1 << 16)
            up, down = np.full(size, ODD, np.uint64), np.full(size, pow(ODD, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return cls.up, cls.down

    def __init__(self, data: np.ndarray):
        self.up_, down = self.powers(len(data))
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * down[: len(data)], out=self.sum[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice, up: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * up)


def _piece_ranges(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """First and last start of each context, its anchor's hash, and its own hash."""
    n = len(data)
    if n < length:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
    hasher = Hasher(data)
    up = hasher.up_[: n - gram + 1]
    grams = hasher.of(slice(0, n - gram + 1), slice(gram, n + 1), up)
    # Hash and place in one number: of equal hashes the first place is the smallest.
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    inside = np.ones(len(low), bool)
    for e in ends.tolist():
        inside[max(0, e - length + 1) : e] = False
    start = np.flatnonzero(inside)
    anchor = (low[start] & PLACE).astype(np.int64)
    if not len(start):
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
    new = np.flatnonzero(
        np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    )
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    at = anchor[new]
    context = hasher.of(first, last + length, hasher.up_[first])
    shape = ((last - first) * 65536 + (at - first)).astype(np.uint64)
    return first, last, grams[at], mix(context ^ mix(shape + np.uint64(ODD)))


def contexts(text: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Contexts of texts: text number, place in its list, first and last start, two hashes.

    What a text gives does not depend on the others.
    """
    out: list[tuple] = []
    group: list[int] = []

    def flush() -> None:
        if group:
            data = np.frombuffer(b"".join(text[i] for i in group), np.uint8)
            ends = np.cumsum([len(text[i]) for i in group])
            first, last, anchor, own = _piece_ranges(data, ends, length, gram)
            where = np.searchsorted(ends, first, "right")
            base = np.concatenate([[0], ends[:-1]])[where]
            out.append((np.array(group)[where], first - base, last - base, anchor, own))
            group.clear()

    size = 0
    for i, t in enumerate(text):
        if len(t) > PIECE:
            for at in range(0, len(t), PIECE):
                data = np.frombuffer(t[at : at + PIECE + length - 1], np.uint8)
                first, last, anchor, own = _piece_ranges(data, np.array([len(data)]), length, gram)
                out.append((np.full(len(first), i), first + at, last + at, anchor, own))
        elif len(t) >= length:
            group.append(i)
            size += len(t)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    columns = [np.concatenate(c) if c else np.zeros(0) for c in (zip(*out, strict=True) if out else [[]] * 5)]
    doc, first, last, anchor, own = (c.astype(k) for c, k in zip(columns, kinds, strict=True))
    order = np.lexsort((first, doc))
    doc = doc[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
    return doc, place, first[order], last[order], anchor[order], own[order]


class Transforms:
    """Burrows-Wheeler transforms of the contexts of each shard.

    A context is eight strings of symbols of eight bytes, one for each phase,
    each with an end of its own, so every byte begins a suffix.  Rows are the
    sorted suffixes of one shard after the other; ``before`` is the symbol
    before a suffix (0: none), ``to`` the row of the suffix that begins there.
    """

    def __init__(self, found: list[bytes], shard: np.ndarray):
        size = np.array([len(c) for c in found], np.int64)
        data = np.frombuffer(b"".join(found), np.uint8).astype(np.uint64)
        value = np.zeros(len(data) - SYMBOL + 1, np.uint64)
        for j in range(SYMBOL):
            value |= data[j : len(data) - SYMBOL + 1 + j] << np.uint64(8 * j)
        count = size - SYMBOL + 1
        self.owner = np.repeat(np.arange(len(found)), count)
        begin = np.cumsum(count) - count
        self.place = np.arange(int(count.sum())) - begin[self.owner]
        byte = (np.cumsum(size) - size)[self.owner] + self.place
        symbol = np.unique(value[byte], return_inverse=True)[1] + 1
        n, strings = len(symbol), SYMBOL * len(found)
        # Ends come after the suffixes in numbering: end of string s is n + s.
        self.n = n
        string = self.owner * SYMBOL + self.place % SYMBOL
        left = (count[self.owner] - 1 - self.place) // SYMBOL
        symbols = np.concatenate([symbol, np.zeros(strings, np.int64)])
        of = np.concatenate([shard[self.owner], np.repeat(shard, SYMBOL)])
        order = stable_order(symbols)
        order = order[stable_order(of[order])]
        start = np.concatenate(
            [[True], (symbols[order][1:] != symbols[order][:-1]) | (of[order][1:] != of[order][:-1])]
        )
        start |= order >= n
        head = np.flatnonzero(start)
        rank = np.empty(n + strings, np.int64)
        rank[order] = head[np.cumsum(start) - 1]
        # Ties within a shard: twice as many symbols each time.
        step = 1
        while True:
            many = np.bincount(rank, minlength=len(rank))
            tied = np.flatnonzero(many[rank[:n]] > 1)
            if not len(tied):
                break
            nxt = np.where(step <= left[tied], tied + SYMBOL * step, n + string[tied])
            later = rank[np.minimum(nxt, len(rank) - 1)]
            by = np.lexsort((later, rank[tied]))
            r, f = rank[tied][by], later[by]
            group = np.concatenate([[True], r[1:] != r[:-1]])
            fresh = group | np.concatenate([[True], f[1:] != f[:-1]])
            at = np.arange(len(by))
            rank[tied[by]] = r + at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] - at[np.flatnonzero(group)][np.cumsum(group) - 1]
            step *= 2
        row = rank
        previous = np.where(self.place >= SYMBOL, np.arange(n) - SYMBOL, -1)
        final = np.empty(strings, np.int64)
        final[string] = -1
        ending = left == 0
        final[string[ending]] = np.flatnonzero(ending)
        previous = np.concatenate([previous, final])
        self.suffix = np.empty(n + strings, np.int64)
        self.suffix[row] = np.arange(n + strings)
        before = previous[self.suffix]
        self.before = np.where(before >= 0, symbols[before], 0)
        self.to = np.where(before >= 0, row[before], -1)

    def repeated(self, symbols: int) -> np.ndarray:
        """Suffixes whose first ``symbols`` symbols another suffix has too.

        The interleave starts with one shard after the other.  After h rounds
        it is right for the first h symbols, and a run of suffixes that agree
        in them is one interval; its suffixes step one symbol back, in order of
        that symbol, and stay apart if their intervals were.  An interval of
        one suffix has nothing in common with any and leaves.
        """
        row = np.arange(len(self.to))
        interval = np.zeros(len(row), np.int64)
        for _ in range(symbols):
            before = self.before[row]
            has = before > 0
            row, before, interval = row[has], before[has], interval[has]
            order = stable_order(before)
            before, interval, row = before[order], interval[order], self.to[row[order]]
            if not len(row):
                break
            edge = np.concatenate(
                [[True], (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])]
            )
            interval = np.cumsum(edge) - 1
            shared = np.bincount(interval)[interval] > 1
            row, interval = row[shared], interval[shared]
        return self.suffix[row]


def repeated_starts(found: list[bytes], shard: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the starts of the strings of ``length`` bytes found again
    in it or in another."""
    t = Transforms(found, shard)
    suffix = np.sort(t.repeated(length // SYMBOL))
    cut = np.searchsorted(t.owner[suffix], np.arange(len(found) + 1))
    return [t.place[suffix[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.concatenate([[0], cut + 1])], x[np.append(cut, len(x) - 1)]


def _owner(rid: np.ndarray, buckets: int) -> np.ndarray:
    return rid % buckets


def _verdicts(read: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """What is known of contexts from hashes: text, place, ALL (repeated as a
    whole), SHIP (to be compared), BOTH; packed by bucket of texts."""

    def local(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, limit=PIECE):
            ids = batch.column(0).to_numpy()
            doc, place, _, _, anchor, own = contexts(raw(batch.column(1)), length, gram)
            rid, place = ids[doc], place.astype(np.int32)
            order = np.lexsort((own, anchor))
            anchor, own, rid, place = anchor[order], own[order], rid[order], place[order]
            first = np.ones(len(own), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            head = np.flatnonzero(first)
            many = np.diff(np.append(head, len(own))) > 1
            # Copies within the batch are settled; one of them stands for all.
            yield from _dealt(
                (anchor[head] % np.uint64(buckets)).astype(np.int64),
                anchor[head], own[head], rid[head], place[head], many.astype(np.uint8),
            )
            rest = np.flatnonzero(~first)
            if len(rest):
                yield from _dealt(
                    _owner(rid[rest], buckets) + buckets,
                    rid[rest], rid[rest], rid[rest], place[rest], np.full(len(rest), ALL, np.uint8),
                )

    def decide(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, anchor, own, rid, place, many in _by_bucket(source, ["u8", "u8", "i8", "i4", "u1"]):
            if bucket >= buckets:
                yield from _dealt(np.full(len(rid), bucket - buckets), rid, place, many)
                continue
            order = np.lexsort((own, anchor))
            anchor, own, rid, place, many = (x[order] for x in (anchor, own, rid, place, many))
            new = np.ones(len(own), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            which = np.cumsum(new) - 1
            size = np.bincount(which) + np.bincount(which, weights=many).astype(np.int64)
            double = (size > 1)[which]
            new_anchor = np.ones(len(own), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            group = np.cumsum(new_anchor) - 1
            single = np.bincount(group, weights=~double) > 0
            kinds = np.bincount(group, weights=new)
            compare = (single & (kinds > 1))[group]
            status = np.where(double, ALL, 0) + np.where(compare & new, SHIP, 0)
            keep = status > 0
            yield from _dealt(
                _owner(rid[keep], buckets), rid[keep], place[keep], status[keep].astype(np.uint8)
            )

    return cut_lineage(
        read.select("rid", "text")
        .mapInArrow(local, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(decide, "bucket int, c0 binary, c1 binary, c2 binary")
    )


def _with_texts(read: DataFrame, buckets: int, *packed: DataFrame) -> DataFrame:
    """Texts and packed rows about them, those of a bucket together, packed rows first."""
    none = lambda t: F.lit(None).cast(t)
    rows = read.select(
        F.pmod("rid", F.lit(buckets)).cast("int").alias("bucket"),
        F.lit(9).alias("kind"), "rid", "doc_id", "text",
        *[none("binary").alias(f"c{i}") for i in range(4)],
    )
    for kind, p in enumerate(packed):
        have = [c for c in p.columns if c.startswith("c")]
        rows = rows.unionByName(
            p.select(
                "bucket", F.lit(kind).alias("kind"), none("long").alias("rid"),
                none("long").alias("doc_id"), none("string").alias("text"),
                *[F.col(c) if c in have else none("binary").alias(c) for c in ("c0", "c1", "c2", "c3")],
            )
        )
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "rid")


def _buckets_of(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple]]]:
    """For each bucket its packed rows by kind and its texts (rid, doc_id, text).

    Texts come in lists of bounded size, with the same packed rows again."""
    now, packed, held, size = None, {}, [], 0
    for batch in source:
        columns = [c.to_pylist() for c in batch.columns[:4]] + [raw(batch.column(4))]
        columns += [c.to_pylist() for c in batch.columns[5:]]
        for bucket, kind, rid, doc_id, text, *c in zip(*columns, strict=True):
            if held and (bucket != now or size >= PIECE):
                yield packed, held
                held, size = [], 0
            if bucket != now:
                now, packed = bucket, {}
            if kind == 9:
                held.append((rid, doc_id, text))
                size += len(text)
            else:
                packed.setdefault(kind, []).append(c)
    if held:
        yield packed, held


def _unpacked(rows: list, kinds: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(r[i] for r in rows), k) for i, k in enumerate(kinds)]


class Lookup:
    """Packed rows of a bucket, found by text."""

    def __init__(self, rows: list, kinds: list[str]):
        columns = _unpacked(rows, kinds)
        order = np.lexsort((columns[1], columns[0]))
        self.columns = [c[order] for c in columns]

    def of(self, rid: int) -> list[np.ndarray]:
        a = np.searchsorted(self.columns[0], rid, "left")
        b = np.searchsorted(self.columns[0], rid, "right")
        return [c[a:b] for c in self.columns[1:]]


def _shipped(read: DataFrame, verdicts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """The bytes of contexts to be compared, by bucket of anchors."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = (None, None), set()
        for packed, held in _buckets_of(source):
            if made[0] is not packed:
                made, seen = (packed, Lookup(packed.get(0, []), ["i8", "i4", "u1"])), set()
            want = {}
            for rid, _, text in held:
                place, status = made[1].of(rid)
                ship = status >= SHIP
                if rid not in seen and ship.any():
                    want[rid] = (text, place[ship], status[ship])
                    seen.add(rid)
            if not want:
                continue
            doc, _, first, last, anchor, _ = contexts([w[0] for w in want.values()], length, gram)
            begin = np.searchsorted(doc, np.arange(len(want)))
            rows: list[tuple] = []
            for k, (rid, (text, place, status)) in enumerate(want.items()):
                for p, s in dict(zip(place.tolist(), status.tolist(), strict=True)).items():
                    i = begin[k] + p
                    rows.append((int(anchor[i]), rid, p, s, text[first[i] : last[i] + length]))
            where = np.array([r[0] for r in rows], np.uint64) % np.uint64(buckets)
            for b in np.unique(where).tolist():
                mine = [r for r, w in zip(rows, where.tolist(), strict=True) if w == b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()),
                        pa.array([np.array([r[0] for r in mine], np.uint64).tobytes()]),
                        pa.array([np.array([r[1] for r in mine], np.int64).tobytes()]),
                        pa.array([np.array([r[2:4] + (len(r[4]),) for r in mine], np.int32).tobytes()]),
                        pa.array([b"".join(r[4] for r in mine)]),
                    ],
                    names=["bucket", "c0", "c1", "c2", "c3"],
                )

    return _with_texts(read, buckets, verdicts).mapInArrow(
        run, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary"
    )


def _compared(shipped: DataFrame, buckets: int, length: int) -> DataFrame:
    """Runs of repeated starts within contexts, packed by bucket of texts: text,
    place, first and last start relative to the context."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in source:
            for bucket, *c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if bucket != now and rows:
                    yield from merged(rows)
                    rows = []
                now = bucket
                anchor, rid = np.frombuffer(c[0], np.uint64), np.frombuffer(c[1], np.int64)
                meta = np.frombuffer(c[2], np.int32).reshape(-1, 3)
                end = np.cumsum(meta[:, 2])
                shard = len(rows) and rows[-1][4] + 1
                rows += [
                    (int(anchor[i]), int(rid[i]), int(meta[i, 0]), int(meta[i, 1]), shard, c[3][end[i] - meta[i, 2] : end[i]])
                    for i in range(len(anchor))
                ]
        if rows:
            yield from merged(rows)

    def merged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0], r[4]))
        out: list[tuple] = []
        at = 0
        while at < len(rows):
            size, end = 0, at
            while end < len(rows) and (size < MERGE_BYTES or rows[end][0] == rows[end - 1][0]):
                size += len(rows[end][5])
                end += 1
            part = rows[at:end]
            shard = np.unique([r[4] for r in part], return_inverse=True)[1].astype(np.int64)
            by = np.argsort(shard, kind="stable")
            part = [part[i] for i in by]
            for r, starts in zip(part, repeated_starts([r[5] for r in part], shard[by], length), strict=True):
                if r[3] == SHIP and len(starts):
                    for a, b in zip(*_runs(starts), strict=True):
                        out.append((r[1], r[2], a, b))
            at = end
        if out:
            rid = np.array([o[0] for o in out], np.int64)
            rest = np.array([o[1:] for o in out], np.int32)
            yield from _dealt(_owner(rid, buckets), rid, rest[:, 0].copy(), rest[:, 1].copy(), rest[:, 2].copy())

    return (
        shipped.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(run, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte is removed if a string of ``length`` bytes that covers it starts
    anywhere else too, in the same or another text.  Strings are judged on the
    input, never cross texts and may overlap.  Null and empty texts and those
    shorter than ``length`` stay as they are; repeated rows are repeats of each
    other; an empty table gives an empty result; columns other than doc_id and
    text are ignored.  ``length`` is a multiple of eight and over ``gram``.

    Anchors, contexts and results travel as packed numbers, one row per batch
    and bucket; copies within a batch are settled there.  Only contexts that
    share an anchor with a different context are sent as bytes, one of each
    kind.  A task holds one bucket of contexts or one of texts.
    """
    read = texts(docs).withColumn("rid", F.xxhash64("doc_id", "text"))
    buckets = 4 * shuffle_width(docs.sparkSession)
    verdicts = _verdicts(read, buckets, length, gram)
    found = cut_lineage(_compared(_shipped(read, verdicts, buckets, length, gram), buckets, length))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (None, None, None)
        for packed, held in _buckets_of(source):
            if made[0] is not packed:
                made = (
                    packed,
                    Lookup(packed.get(0, []), ["i8", "i4", "u1"]),
                    Lookup(packed.get(1, []), ["i8", "i4", "i4", "i4"]),
                )
            touched = [k for k, h in enumerate(held) if len(made[1].of(h[0])[0])]
            doc, _, first, last, _, _ = contexts([held[k][2] for k in touched], length, gram)
            begin = dict(zip(touched, np.searchsorted(doc, np.arange(len(touched))).tolist(), strict=True))
            out: list[tuple] = []
            for k, (rid, doc_id, text) in enumerate(held):
                kept, removed, spans = text, 0, 0
                if k in begin:
                    place, status = made[1].of(rid)
                    whole = begin[k] + place[(status & ALL) > 0].astype(np.int64)
                    part, a, b = made[2].of(rid)
                    base = first[begin[k] + part.astype(np.int64)]
                    starts = np.concatenate([first[whole], base + a])
                    ends = np.concatenate([last[whole], base + b]) + length
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, starts, 1)
                    np.add.at(step, ends, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if removed else 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return _with_texts(read, buckets, verdicts, found).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
