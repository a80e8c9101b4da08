"""Benchmark decontamination: BM25 index of test items, block-max WAND, verified overlap."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, raw, texts
from loregraph.session import ship

K1, B = 1.2, 0.75
SHINGLE = 5
# Items whose largest weights are kept together, and groups of such blocks.
BLOCK = 4
GROUPS = 64
# Words by which a leaked item may be longer than the item.
SPARE = 16
# Bytes of test items in one index; more items make more indexes.
INDEX_BYTES = 16 << 20
ITEM = itemgetter(0)
PLAIN = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case: runs of letters, digits and non-ASCII signs."""
    return text.decode("utf-8", "replace").lower().encode().translate(PLAIN).split()


def in_order(words: tuple[bytes, ...], passage: list[bytes]) -> int:
    """Words that are found in the same order in a stretch of the passage that
    is at most ``SPARE`` words longer: the longest common subsequence, by bits."""
    bits: dict[bytes, int] = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    match = [bits.get(w, 0) for w in passage]
    starts = [i for i, m in enumerate(match) if m]
    best, everything = 0, (1 << len(words)) - 1
    for k, at in enumerate(starts):
        end = at + len(words) + SPARE
        # No more words are in order than are found at all.
        if bisect_left(starts, end) - k <= best:
            continue
        free = everything
        for i in starts[k : bisect_left(starts, end)]:
            hit = free & match[i]
            free = (free + hit | free - hit) & everything
        best = max(best, len(words) - free.bit_count())
    return best


class Index:
    """Postings of the test items, by word; weights are shares of an item's own score.

    With them a passage that holds all words of an item scores 1 for it.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        found = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in found]
        self.words = [w for _, w in found]
        n = len(found)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for w in self.words for x in w))}
        doc = np.repeat(np.arange(n), [len(w) for w in self.words])
        word = np.array([self.vocabulary[x] for w in self.words for x in w], np.int64)
        key, tf = np.unique(word * max(1, n) + doc, return_counts=True)
        self.term, self.item = key // max(1, n), key % max(1, n)
        size = np.bincount(doc, minlength=n)
        df = np.bincount(self.term, minlength=len(self.vocabulary))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size[self.item] / max(1e-9, size.mean() if n else 1))
        w = idf[self.term] * tf * (K1 + 1) / (tf + norm)
        own = np.bincount(self.item, weights=w, minlength=n)
        self.weight = w / own[self.item]
        self.start = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        self.stride = int(max([len(w) for w in self.words], default=1)) + SPARE
        # Largest weight of each word in each group of items; one more row for other words.
        group = self.item * GROUPS // max(1, n)
        self.bound = np.zeros((len(self.vocabulary) + 1, GROUPS), np.float32)
        np.maximum.at(self.bound, (self.term, group), self.weight.astype(np.float32) * 1.00001)
        self.group_start = np.searchsorted(np.arange(n) * GROUPS // max(1, n), np.arange(GROUPS + 1))
        self.postings: dict[int, tuple] = {}

    def numbers(self, lists: list[list[bytes]]) -> np.ndarray:
        get, other = self.vocabulary.get, len(self.vocabulary)
        total = sum(map(len, lists))
        return np.fromiter((get(w, other) for words in lists for w in words), np.int32, total)

    def wand(self, terms: list[int], threshold: float, low: int, high: int) -> list[tuple[int, float]]:
        """All items from ``low`` to before ``high`` that score ``threshold`` or more for a set of words.

        Cursors in item order; the pivot is the first item at which the
        largest weights passed add up to the threshold.  Where the largest
        weights in the pivot's block do not, the cursors move past the block.
        """
        cursors = []
        for t in terms:
            items, weights, blocks = self.posting(t)
            at = bisect_left(items, low)
            end = bisect_left(items, high, at)
            if at < end:
                cursors.append([items[at], at, end, max(weights[at:end]), items, weights, blocks])
        threshold -= 1e-9
        found = []

        def move(c: list, to: int) -> None:
            c[1] = bisect_left(c[4], to, c[1], c[2])
            c[0] = c[4][c[1]] if c[1] < c[2] else high

        while True:
            cursors.sort(key=ITEM)
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= high:
                    break
                total += c[3]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            ahead = cursors[: pivot + 1]
            block = at // BLOCK
            if sum(c[6].get(block, 0.0) for c in ahead) < threshold:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = max(at + 1, min(to, cursors[pivot + 1][0]))
                for c in ahead:
                    move(c, to)
            elif cursors[0][0] == at:
                score = sum(c[5][c[1]] for c in ahead)
                if score >= threshold:
                    found.append((at, score))
                for c in ahead:
                    move(c, at + 1)
            else:
                for c in ahead:
                    move(c, at)

    def posting(self, t: int) -> tuple[list[int], list[float], dict[int, float]]:
        """Items of a word, its weights there, and the largest weight in each block."""
        known = self.postings.get(t)
        if known is None:
            at = slice(self.start[t], self.start[t + 1])
            items, weights = self.item[at].tolist(), self.weight[at].tolist()
            blocks: dict[int, float] = {}
            for i, w in zip(items, weights, strict=True):
                blocks[i // BLOCK] = max(w, blocks.get(i // BLOCK, 0.0))
            known = self.postings[t] = (items, weights, blocks)
        return known

    def overlap(self, k: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words (the first and
        the second half of an item) that the passage has too: in windows of
        five words, or in order within a stretch little longer than the half,
        whichever is more."""
        words = tuple(self.words[k])
        middle = len(words) // 2
        size = min(SHINGLE, len(words))
        have = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        covered = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            if words[i : i + size] in have:
                covered[i : i + size] = True
        question, answer = (
            max(int(c.sum()), in_order(w, passage)) / len(w) if w else 1.0
            for w, c in ((words[:middle], covered[:middle]), (words[middle:], covered[middle:]))
        )
        return question, answer

    def search(self, text: list[bytes], threshold: float, least: float) -> list[tuple]:
        """(text number, item, score, question and answer overlap), best passage of each pair."""
        lists = [words_of(t) for t in text]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        number = self.numbers(lists)
        other = len(self.vocabulary)
        # Half passages: stretches of ``stride`` words; a passage is two of them.
        halves = np.maximum(1, -(-count // self.stride))
        first = np.cumsum(halves) - halves
        place = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
        half = np.repeat(first, count) + place // self.stride
        known = number < other
        key = np.unique(half[known] * (other + 1) + number[known])
        at, term = key // (other + 1), (key % (other + 1)).astype(np.int64)
        bound = np.zeros((int(halves.sum()), GROUPS), np.float32)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        if len(cut):
            bound[at[cut]] = np.add.reduceat(self.bound[term], cut, axis=0)
        owner = np.repeat(np.arange(len(text)), halves)
        cuts = np.searchsorted(at, np.arange(len(owner) + 1))
        both = bound.copy()
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        both[follows] += bound[follows + 1]
        best: dict[tuple[int, int], tuple] = {}
        where, groups = np.nonzero(both >= threshold - 1e-4)
        for h, g in zip(where.tolist(), groups.tolist(), strict=True):
            doc = int(owner[h])
            begin = (h - int(first[doc])) * self.stride
            passage = lists[doc][begin : begin + 2 * self.stride]
            span = slice(cuts[h], cuts[h + 2] if h + 1 < len(owner) and owner[h + 1] == doc else cuts[h + 1])
            terms = np.unique(term[span]).tolist()
            for k, score in self.wand(terms, threshold, *self.group_start[g : g + 2].tolist()):
                question, answer = self.overlap(k, passage)
                row = (min(question, answer), score, question, answer)
                if min(question, answer) >= least and row > best.get((doc, k), (0.0,)):
                    best[doc, k] = row
        return [(d, self.ids[k], *row[1:]) for (d, k), row in sorted(best.items())]


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.7, least: float = 0.8
) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a test item, with score and overlaps.

    Each whole text is cut into passages of twice the longest item that overlap
    by half, so an item in it lies whole in one.  All items whose BM25 score
    for a passage is at least ``threshold`` of their own are retrieved; a pair
    is kept if the text has ``least`` of the words of the item's first half
    (question) and of its second half (answer), each in windows of five words
    or in order within a stretch ``SPARE`` words longer than the half, so that
    single changed, missing or added words do not hide a leak.

    Null and empty texts and items match nothing; an item of fewer words than
    five is one window; equal items match alike; repeated rows give repeated
    pairs; empty tables give an empty result; columns other than doc_id, text,
    item_id are ignored.  No shuffle.  The test items are cut into indexes of
    bounded size, each of which sees all documents.
    """
    ship(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    indexes = 1 + size // INDEX_BYTES
    schema = "doc_id long, item_id long, score double, question double, answer double"
    out = None
    for k in range(indexes):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(indexes)) == k).orderBy("item_id", "text")
        index = Index([(r["item_id"], r["text"].encode()) for r in part.collect()])
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(source):
                ids = batch.column(0).to_pylist()
                found = shared.value.search(raw(batch.column(1)), threshold, least)
                rows = [(ids[f[0]], *f[1:]) for f in found]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    names=["doc_id", "item_id", "score", "question", "answer"],
                )

        hits = texts(docs).mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out
