"""Lexical retrieval packing: BM25 neighbours fill the window of a seed document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.bpe import transducer
from loregraph.llm.common import batches, raw, texts
from loregraph.llm.components import connected
from loregraph.llm.token_count import vocabulary
from loregraph.session import cut_lineage, shuffle_width

K1, B = 1.2, 0.75
# Bytes of packed ids that are filled into windows at a time, about 2 MB of text.
SHARD_BYTES = 1 << 20
# Terms of largest weight by which a document looks for neighbours, and the
# number of documents from which on a term must meet another one.
STRONGEST = 4
HOT = 256
# Documents compared at a time: of several small groups, of a large one.
SMALL, LARGE = 128, 512
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@dataclass
class Item:
    """A document, or what is left of it, that waits for a place."""

    doc_id: int | None
    ids: np.ndarray
    start: int

    @property
    def left(self) -> int:
        return len(self.ids) - self.start


@dataclass
class Statistics:
    """Documents of the corpus that hold each token, their number and mean length."""

    df: np.ndarray
    n: int
    mean: float

    @property
    def idf(self) -> np.ndarray:
        """Terms in half of the documents or more say nothing."""
        return np.maximum(0.0, np.log((self.n - self.df + 0.5) / (self.df + 0.5)))


class Index:
    """Inverted BM25 index of the items of one shard, weighted by the corpus's statistics if given."""

    def __init__(self, items: list[Item], corpus: Statistics | None = None):
        n = self.n = len(items)
        size = np.array([x.left for x in items], np.int64)
        token = np.concatenate([x.ids[x.start :] for x in items]).astype(np.int64)
        key, tf = np.unique(token * n + np.repeat(np.arange(n), size), return_counts=True)
        term, self.item = key // n, key % n
        first = np.concatenate([[True], term[1:] != term[:-1]])
        start = np.flatnonzero(first)
        df = np.diff(np.append(start, len(term)))
        # Of terms that say nothing no postings are read.
        idf = corpus.idf[term[start]] if corpus else Statistics(df, n, 0.0).idf
        number = np.cumsum(first) - 1
        norm = K1 * (1 - B + B * size[self.item] / (corpus.mean if corpus else size.mean()))
        self.weight = idf[number] * tf * (K1 + 1) / (tf + norm)
        useful = (idf[number] > 0) & (df[number] > 1)
        by_item = np.argsort(self.item[useful], kind="stable")
        self.terms = number[useful][by_item]
        self.of = np.searchsorted(self.item[useful][by_item], np.arange(n + 1))
        self.start, self.df = start, df

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every item for the terms of one."""
        terms = self.terms[self.of[item] : self.of[item + 1]]
        if not len(terms):
            return np.zeros(self.n)
        span = self.df[terms]
        at = np.repeat(self.start[terms] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        return np.bincount(self.item[at], weights=self.weight[at], minlength=self.n)


def fill(
    items: list[Item], size: int, corpus: Statistics | None = None
) -> tuple[list[list[tuple[Item, int, int]]], list[Item]]:
    """Windows of exactly ``size`` tokens as lists of (item, start, length), and what is left over.

    A document longer than a window fills windows by itself.  What remains of
    it, or a shorter document, is a seed: unused neighbours follow in the order
    of their scores, then those without any, until the window is full.  The
    last one is cut and its rest is the next seed.
    """
    windows = []
    for x in items:
        while x.left >= size:
            windows.append([(x, x.start, size)])
            x.start += size
    items = [x for x in items if x.left]
    if sum(x.left for x in items) < size:
        return windows, items
    index = Index(items, corpus)
    unused = np.ones(len(items), bool)
    total, seed, following = sum(x.left for x in items), -1, 0
    while total >= size:
        if seed < 0:
            while not unused[following]:
                following += 1
            seed = following
        unused[seed] = False
        x = items[seed]
        window, room = [(x, x.start, x.left)], size - x.left
        x.start = len(x.ids)
        score = np.where(unused, index.scores(seed), -1.0) if room else None
        seed = -1
        while room:
            best = int(score.argmax())
            x = items[best]
            take = min(room, x.left)
            window.append((x, x.start, take))
            x.start += take
            room -= take
            unused[best] = False
            score[best] = -1.0
            if x.left:
                seed = best
        windows.append(window)
        total -= size
    return windows, [x for x in items if x.left]


def halves(items: list[Item], size: int) -> list[list[tuple[Item, int, int]]]:
    """What is left at the end of a partition, in sequences whose lengths are powers of two."""
    windows, total = [], sum(x.left for x in items)
    todo = iter(items)
    x = next(todo, None)
    while total:
        room = 1 << min(total.bit_length() - 1, size.bit_length() - 1)
        total -= room
        window = []
        while room:
            take = min(room, x.left)
            window.append((x, x.start, take))
            x.start += take
            room -= take
            if not x.left:
                x = next(todo, None)
        windows.append(window)
    return windows


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in order, and how often each occurs."""
    found = np.sort(ids, kind="stable")
    first = np.ones(len(found) + 1, bool)
    np.not_equal(found[1:], found[:-1], out=first[1:-1])
    at = first.nonzero()[0]
    return found[at[:-1]], at[1:] - at[:-1]


def _tokens(docs: DataFrame, vocab: str | None, end: int) -> DataFrame:
    """doc_id, node (64 bits of the text), n, raw, ids: the packed tokens and their bytes before packing."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, codec = transducer(vocab or vocabulary(), True), pa.Codec("zstd")
        for batch in batches(source, tokenizes=True):
            found = machine.ids([t.decode("utf-8", "replace") for t in raw(batch.column(2))])
            every = [np.append(i, end) for i in found]
            plain = [i.astype("<u2" if i.max() < 1 << 16 else "<u4").tobytes() for i in every]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(i) for i in every], pa.int64()),
                    pa.array([len(p) for p in plain], pa.int64()),
                    pa.array([codec.compress(p, asbytes=True) for p in plain], pa.binary()),
                ],
                names=["doc_id", "node", "n", "raw", "ids"],
            )

    read = texts(docs).select("doc_id", F.xxhash64("text").alias("node"), "text")
    return read.mapInArrow(run, "doc_id long, node long, n long, raw long, ids binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The token ids of each row with columns n, raw and ids."""
    codec = pa.Codec("zstd")
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "raw", "ids")]
    for n, size, packed in zip(*columns, strict=True):
        yield np.frombuffer(codec.decompress(packed, size, asbytes=True), f"<u{size // n}")


def _statistics(tokens: DataFrame) -> Statistics:
    """Counts over all rows of the corpus; a vocabulary is of fixed size and so are they."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches(source, "ids"):
            for ids in _unpacked(batch):
                term = terms_of(ids)[0]
                if term[-1] >= len(df):
                    df = np.append(df, np.zeros(int(term[-1]) + 1, np.int64))
                df[term] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    counts = tokens.select("n", "raw", "ids").mapInArrow(run, "term long, df long")
    rows = counts.groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max([r["term"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        df[r["term"]] = r["df"]
    return Statistics(df, total[0], (total[1] or 0) / max(1, total[0]))


def _routes(tokens: DataFrame, shared) -> DataFrame:
    """key, node, n, terms, vector: each document under its strongest terms.

    A term of at most ``HOT`` documents is a key by itself.  Of the others
    every two are one, so that groups grow slowly with the corpus.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, codec = shared.value, pa.Codec("zstd")
        idf, df = corpus.idf, corpus.df
        for batch in batches(source, "ids"):
            out: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in range(2)]
            for node, n, ids in zip(*columns, _unpacked(batch), strict=True):
                term, tf = terms_of(ids)
                useful = (idf[term] > 0) & (df[term] > 1)
                term, tf = term[useful].astype(np.int64), tf[useful]
                less = -(idf[term] * tf / (tf + K1 * (1 - B + B * n / corpus.mean)))
                # Of equal weights the smaller term counts; terms are in order.
                at = np.flatnonzero(less <= np.partition(less, STRONGEST)[STRONGEST]) if len(less) > STRONGEST else slice(None)
                top = term[at][np.argsort(less[at], kind="stable")[:STRONGEST]]
                hot = np.sort(top[df[top] > HOT]).tolist()
                keys = [-1 - t for t in top[df[top] <= HOT].tolist()]
                keys += [x << 32 | y for i, x in enumerate(hot) for y in hot[i + 1 :]]
                if keys or hot:
                    plain = np.empty(2 * len(term), "<u4")
                    plain[: len(term)], plain[len(term) :] = term, tf
                    plain[1 : len(term)] -= term[:-1].astype("<u4")
                    packed = codec.compress(plain.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)
                    out += [(k, node, n, len(term), packed) for k in keys or [-1 - hot[0]]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["key", "node", "n", "terms", "vector"],
            )

    read = tokens.select("node", "n", "raw", "ids")
    return read.mapInArrow(run, "key long, node long, n long, terms long, vector binary")


class Vectors:
    """Documents that share keys, for scores of each against each."""

    def __init__(self, corpus: Statistics):
        self.idf, self.mean = corpus.idf.astype(np.float32), corpus.mean
        self.place = np.zeros(len(self.idf), np.int64)
        self.codec = pa.Codec("zstd")

    def read(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of documents, one after the other, their BM25 weights, and how many each has."""
        size = np.array([r[3] for r in rows], np.int64)
        plain = [self.codec.decompress(r[4], 8 * r[3], asbytes=True) for r in rows]
        data = np.frombuffer(b"".join(plain), np.uint8)
        # Four planes of bytes for each document, each of its terms' differences and their numbers.
        before, span = np.cumsum(size) - size, np.repeat(size, size)
        at = np.arange(len(span)) + np.repeat(7 * before, size)
        step, tf = data[at].astype(np.int64), data[at + span].astype(np.int64)
        for shift in (8, 16, 24):
            at += 2 * span
            step |= data[at].astype(np.int64) << shift
            tf |= data[at + span].astype(np.int64) << shift
        total = np.concatenate([[0], np.cumsum(step)])
        term, tf = total[1:] - np.repeat(total[before], size), tf.astype(np.float32)
        n = np.array([r[2] for r in rows], np.int64)
        norm = np.repeat((K1 * (1 - B + B * n / self.mean)).astype(np.float32), size)
        return term, self.idf[term] * tf * np.float32(K1 + 1) / (tf + norm), size

    def scores(self, seeds: tuple, others: tuple) -> np.ndarray:
        """BM25 of each of the others for all terms of each seed."""
        term, weight, size = others
        names = np.flatnonzero(np.bincount(term, minlength=len(self.place)))
        self.place[:] = -1
        self.place[names] = np.arange(len(names))
        have = np.zeros((len(size), len(names)), np.float32)
        have[np.repeat(np.arange(len(size)), size), self.place[term]] = weight
        asked = self.place[seeds[0]]
        row = np.repeat(np.arange(len(seeds[2])), seeds[2])
        want = np.zeros((len(seeds[2]), len(names)), np.float32)
        want[row[asked >= 0], asked[asked >= 0]] = 1
        return want @ have.T


def _nearest(routes: DataFrame, shared) -> DataFrame:
    """a, b, score, key: the best neighbour b of each document a within each group of a key.

    Rows come sorted by key and node.  Every document of a group is scored
    against every other one; of equal scores the smaller node counts.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Vectors(shared.value)
        held: list[list[tuple]] = []
        group: list[tuple] = []
        now = None
        for batch in source:
            for key, node, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    held.append(group)
                    group, now = [], key
                    if sum(map(len, held)) >= SMALL:
                        yield best(space, held)
                        held = []
                if not group or group[-1][1] != node:  # copies are one
                    group.append((key, node, *rest))
        yield best(space, [*held, group])

    def best(space: Vectors, groups: list[list[tuple]]) -> pa.RecordBatch:
        groups = [g for g in groups if len(g) > 1]
        rows = [r for g in groups for r in g]
        node = np.array([r[1] for r in rows], np.int64)
        of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        top = np.full(len(rows), -1.0, np.float32)
        to = np.zeros(len(rows), np.int64)
        read = space.read(rows) if 0 < len(rows) <= LARGE else None
        for i in range(0, len(rows), LARGE):
            seeds = slice(i, i + LARGE)
            ours = read or space.read(rows[seeds])
            for j in range(0, len(rows), LARGE):
                others = slice(j, j + LARGE)
                if of[i] > of[others][-1] or of[seeds][-1] < of[j]:
                    continue
                score = space.scores(ours, read or space.read(rows[others]))
                score[of[seeds, None] != of[others]] = -1
                score[node[seeds, None] == node[others]] = -1
                at = score.argmax(1)
                value = score[np.arange(len(at)), at]
                # Nodes of a group are in order: an earlier block keeps what is equal.
                better = value > top[seeds]
                top[seeds][better] = value[better]
                to[seeds][better] = node[others][at[better]]
        keep = top > 0
        key = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (node, to, top, key)], names=["a", "b", "score", "key"]
        )

    return routes.mapInArrow(run, "a long, b long, score float, key long")


def _places(tokens: DataFrame, corpus: Statistics) -> DataFrame:
    """node, part, lead, root: where each text goes, so that best neighbours of the corpus are close.

    Texts that best neighbours connect share a root.  Roots follow each other
    by the key of the best score among their texts; texts alone come first.
    """
    spark = tokens.sparkSession
    shared, width = spark.sparkContext.broadcast(corpus), shuffle_width(spark)
    routes = _routes(tokens, shared).repartition(width, "key").sortWithinPartitions("key", "node")
    found = _nearest(routes, shared).groupBy("a").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "b", "key")).alias("best")
    )
    found = cut_lineage(found.select("a", "best.*"))
    roots = connected(found, "long")
    led = roots.join(found, F.col("node") == F.col("a"), "left").groupBy("root")
    led = led.agg(F.min(F.struct("s", "key")).getField("key").alias("lead"))
    every = tokens.groupBy("node").agg(F.count(F.lit(1)))
    rows = every.select("node").join(roots, "node", "left").join(led, "root", "left")
    rows = rows.select("node", "lead", F.coalesce("root", "node").alias("root"))
    rows = rows.repartitionByRange(width, "lead", "root", "node")
    return cut_lineage(rows.withColumn("part", F.spark_partition_id()))


def pack(
    docs: DataFrame, vocab: str | None = None, size: int = 1024, end: int = 0, with_ids: bool = False
) -> DataFrame:
    """Place every token of every document in exactly one sequence of at most ``size``.

    One row per piece: doc_id, start (tokens of the document before it),
    length, ids_crc32 (of its ids as little-endian 32-bit numbers), doc_tokens,
    sequence_id, offset in the sequence; ``with_ids`` adds the ids.  A document
    is its tokens and then the id ``end``; null and empty texts are that id
    alone.  Repeated rows are packed row by row; an empty table gives an empty
    result; columns other than doc_id and text are ignored.

    Document frequencies and the mean length are those of all rows.  Every
    document looks for its best neighbour in the whole corpus, among those
    that have one of its strongest terms among theirs (two, if the terms are
    frequent), by BM25 over all terms.  Documents that best neighbours connect are brought
    together, whatever file they come from, and windows are filled from what
    then lies in one shard of bounded size; what does not fill a window moves
    on to the next shard.  Sequences are full but for those at the end of a
    partition, whose lengths are powers of two, so nothing is padded if a
    window size is one.  A repeated task gives the same rows, ids included,
    and the order of the rows of the table does not matter.
    """
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    )
    tokens = cut_lineage(_tokens(docs, vocab, end))
    corpus = _statistics(tokens)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        waiting: list[Item] = []
        for batch in batches(source, "ids", SHARD_BYTES):
            found = zip(batch.column(0).to_pylist(), _unpacked(batch), strict=True)
            waiting += [Item(d, i.astype("<u4"), 0) for d, i in found]
            windows, waiting = fill(waiting, size, shared.value)
            yield rows(windows, number)
            number += len(windows)
        if waiting:
            yield rows(halves(waiting, size), number)

    def rows(windows: list[list[tuple[Item, int, int]]], number: int) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, window in enumerate(windows):
            offset = 0
            for x, start, length in window:
                ids = x.ids[start : start + length]
                out.append(
                    (x.doc_id, start, length, zlib.crc32(ids.tobytes()), len(x.ids), number + k, offset)
                )
                if with_ids:
                    out[-1] += (ids.tolist(),)
                offset += length
        names = [*NAMES, "ids"] if with_ids else NAMES
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        kinds = [*[pa.int64()] * len(NAMES), *[pa.list_(pa.int32())] * with_ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names)
        )

    placed = (
        tokens.join(_places(tokens, corpus), "node")
        .repartition(shuffle_width(docs.sparkSession), "part")
        .sortWithinPartitions("part", "lead", "root", "node", "doc_id")
    )
    return placed.select("doc_id", "n", "raw", "ids").mapInArrow(run, schema)
