"""Quality rules: repetition inside a text by a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loregraph.llm.common import batches, raw, texts

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, repeat_words long, "
    "longest_repeat long"
)


class Words:
    """The words of a batch of texts as numbers, one after the other."""

    def __init__(self, text: list[bytes]):
        lists = [t.split() for t in text]
        self.count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = [w for words in lists for w in words]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        self.vocabulary = list(number)
        self.doc = np.repeat(np.arange(len(lists)), self.count)
        self.end = np.cumsum(self.count)
        self.room = self.end[self.doc] - np.arange(len(flat))

    def repeated(self, rank: np.ndarray) -> np.ndarray:
        """Ranks with those that occur once set to -1, the others numbered anew."""
        real = np.flatnonzero(rank >= 0)
        out = np.full(len(rank), -1, np.int64)
        if len(real):
            _, back, many = np.unique(rank[real], return_inverse=True, return_counts=True)
            keep = many[back] > 1
            out[real[keep]] = back[keep]
        return out

    def windows(self) -> dict[int, np.ndarray]:
        """For lengths 1, 2, 3: the number of each repeated window within its text, else -1."""
        n = len(self.word)
        one = self.repeated(self.doc * max(1, len(self.vocabulary)) + self.word)
        two = self.joined(one, one, 1, 2)
        return {1: one, 2: two, 3: self.joined(two, one, 2, 3), 0: np.arange(n)}

    def joined(self, a: np.ndarray, b: np.ndarray, shift: int, length: int) -> np.ndarray:
        """Windows of ``length`` words from windows a and, ``shift`` words on, b."""
        out = np.full(len(a), -1, np.int64)
        at = np.flatnonzero((a >= 0) & (self.room >= length))
        if len(at):
            at = at[b[at + shift] >= 0]
        if len(at):
            out[at] = a[at] * (b.max() + 1) + b[at + shift]
        return self.repeated(out)

    def cover(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which words the spans cover."""
        step = np.zeros(len(self.word) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + length, -1)
        return np.cumsum(step)[:-1] > 0

    def per_doc(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[which], minlength=len(self.count))


def longest_repeats(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share at least ``least`` words with another one of their
    text, and how many words the longest of these shares.

    The suffixes are sorted by doubling: first by their window of ``least``
    words, then by that and the window after it, and so on, while windows of
    the length reached are still repeated.  Suffixes whose first window occurs
    once take no part, and need not: they share fewer words with any other.
    The common prefix of neighbours in sorted order comes from the same
    windows, from long to short; a suffix's longest repeat is the larger of
    its two neighbours' common prefixes, and these spans are those of the
    maximal intervals of common prefixes.
    """
    w = words.windows()
    level = w[1]
    size = 1
    pieces = [1 << k for k in range(least.bit_length()) if least >> k & 1]
    powers = {1: w[1]}
    while size * 2 <= least:
        powers[size * 2] = words.joined(powers[size], powers[size], size, size * 2)
        size *= 2
    level, size = powers[pieces[-1]], pieces[-1]
    for p in reversed(pieces[:-1]):
        level = words.joined(level, powers[p], size, size + p)
        size += p
    levels = [(size, level)]
    while (level >= 0).any():
        level = words.joined(level, level, size, size * 2)
        size *= 2
        if not (level >= 0).any():
            break
        levels.append((size, level))
    suffix = np.flatnonzero(levels[0][1] >= 0)
    if not len(suffix):
        return suffix, suffix
    # Each place stands for its window of ``least`` words, a window that occurs
    # once for itself; ranks by one window, then by two, by four and so on.
    n = len(words.word)
    symbol = np.where(levels[0][1] >= 0, levels[0][1], n + np.arange(n))
    _, rank = np.unique(symbol, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        nxt = np.minimum(suffix + step, n - 1)
        later = np.where(words.room[suffix] > step, rank[nxt] + 1, 0)
        order = np.lexsort((later, rank[suffix]))
        r, f = rank[suffix][order], later[order]
        fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])])
        # Ranks stay in the gaps between those of unique suffixes.
        first = np.concatenate([[True], r[1:] != r[:-1]])
        base = np.flatnonzero(first)[np.cumsum(first) - 1]
        if fresh.all():
            break
        spread = rank * (len(suffix) + 1)
        spread[suffix[order]] = r * (len(suffix) + 1) + np.flatnonzero(fresh)[np.cumsum(fresh) - 1] - base
        _, rank = np.unique(spread, return_inverse=True)
        rank = rank.astype(np.int64)
        step *= 2
    sa = suffix[order]
    lcp = np.zeros(len(sa) - 1, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    live = np.arange(len(a))
    for size, level in reversed(levels):
        # Twice at the longest: windows of twice that size are never repeated.
        ok = live[(a[live] < n) & (b[live] < n)]
        same = (level[a[ok]] >= 0) & (level[a[ok]] == level[b[ok]])
        go = ok[same]
        lcp[go] += size
        a[go] += size
        b[go] += size
    # What is left is shorter than a window: word by word.
    word = words.word
    stop = words.end[words.doc[sa]]
    live = np.flatnonzero(lcp > 0)
    while len(live):
        inside = (a[live] < stop[:-1][live]) & (b[live] < stop[1:][live])
        live = live[inside]
        live = live[word[a[live]] == word[b[live]]]
        lcp[live] += 1
        a[live] += 1
        b[live] += 1
    best = np.zeros(len(sa), np.int64)
    best[:-1] = lcp
    best[1:] = np.maximum(best[1:], lcp)
    return sa, best


def quality_rules(
    docs: DataFrame,
    least: int = 6,
    most_covered: float = 0.5,
    longest: int = 60,
    longest_share: float = 0.2,
) -> DataFrame:
    """Word, symbol, line and repetition counts of each whole text, and a verdict.

    A text passes if it has at least 50 words, at most half of its words lie
    in 3-word windows found more than once, the maximal repeats of at least
    ``least`` words cover at most ``most_covered`` of its words, and the
    longest of them has at most ``longest`` words and ``longest_share`` of the
    text.  Null and empty texts have no words and fail; repeated rows are
    judged row by row; an empty table gives an empty result; columns other
    than doc_id and text are ignored.  No shuffle; a task holds one batch.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            text = raw(batch.column(1))
            w = Words(text)
            three = w.windows()[3]
            start = np.flatnonzero(three >= 0)
            again = w.per_doc(w.cover(start, np.full(len(start), 3)))
            at, size = longest_repeats(w, least)
            covered = w.per_doc(w.cover(at, size))
            most = np.zeros(len(text), np.int64)
            np.maximum.at(most, w.doc[at], size)
            n = w.count
            failed = (n < 50) | (100 * again > 50 * n)
            kept = ~failed & (covered <= most_covered * n)
            kept &= (most <= longest) & (most <= longest_share * n)
            lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in text]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array([len(t.translate(None, WHITE + CONTINUATION)) for t in text], pa.int64()),
                    pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in text], pa.int64()),
                    pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                    pa.array(again.astype(np.int64)),
                    pa.array(failed),
                    pa.array(kept),
                    pa.array(covered.astype(np.int64)),
                    pa.array(most),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
