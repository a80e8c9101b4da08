"""Byte-level BPE compiled to a deterministic finite-state transducer.

Two machines run over a batch of texts.  The first one cuts code points into
pieces (words with their leading blank, numbers, runs of other signs); what it
does at a code point depends on its neighbours only, so it is evaluated for all
code points at once.  The second one reads the bytes of a piece.  Its state
holds, for each place from which a vocabulary entry may still be running, the
trie node reached, the last token of the text before that place and the number
of tokens up to there, relative to now.  Reading a byte leads to one next state
and to one change of the token count, which annotates the transition; the sum
over a piece is its number of tokens, and the last token of each prefix gives
the ids by walking back.

That the last tokens of the prefixes are enough rests on a property of BPE: a
sequence of tokens is the encoding of its text if and only if each neighbouring
pair is the encoding of the text of that pair.

Transitions are compiled when first met and kept for the life of the worker.
A piece resets the machine, so the state map of a stretch of text that begins
with a piece is constant: stretches run side by side in vectors, and their
counts are put together by a prefix sum.

Where ids are wanted, equal pieces are read once: the ids of short pieces are
kept under their bytes, and only pieces not met before pass the machine.  Where
very many pieces are new, ``Merger`` does the merges of all of them at once
instead of compiling transitions for each.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from loregraph.llm.common import mix

LETTER, NUMBER, BLANK, SPACE, OTHER, NONE = range(6)
# Bytes of text between two starting places of the vectors.
STRETCH = 512
# Compiled states kept before the tables are built anew.
MAX_STATES = 200_000
# Places for pieces of at most 15 bytes (as a power of two), and ids kept for
# them before all are forgotten.
PLACES = 20
KEPT_IDS = 8 << 20
SHORT = 15
# Bytes of the longest pieces whose merges are done side by side.
MERGED = 64
# Noted pairs of entries kept before they are forgotten.
MAX_NOTES = 150_000
# Characters worked on at once, so that most vectors stay in the cache.
TOGETHER = 1 << 18
# Entries below a trie node that are tried one by one.
WIDE = 48
NEVER = 1 << 60
UNRANKED = np.int32((1 << 31) - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Vectors shorter than this are run by a plain loop.
FEW_LANES = 12


def _heads() -> np.ndarray:
    """For each number of bytes the bits that the first ones have in two 64-bit numbers."""
    rows = np.zeros((SHORT + 1, 16), np.uint8)
    for n in range(SHORT + 1):
        rows[n, :n] = 255
    return np.ascontiguousarray(rows.view("<u8").T)


HEADS = _heads()


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, kind in (
        (r"\p{L}+", LETTER),
        (r"\p{N}+", NUMBER),
        (r"\p{White_Space}+", SPACE),
    ):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0x20] = BLANK
    return table


class Transducer:
    """The machine of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.vocab = {raw(t): i for t, i in model["vocab"].items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            x, y = self.vocab[a], self.vocab[b]
            self.merges[x, y] = rank
            self.parts.setdefault(self.vocab[a + b], (x, y, rank))
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = (
            re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
            if self.specials
            else None
        )
        self.length = np.zeros(max(self.vocab.values()) + 1, np.int64)
        for t, i in self.vocab.items():
            self.length[i] = len(t)
        self._trie()
        # By two numbers in one: pairs of tokens that stay apart, useful starts.
        self.valid: dict[int, bool] = {}
        self.use: dict[int, bool] = {}
        self._fresh()
        self._forget()

    def _trie(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token_at = [-1]
        for text, token in self.vocab.items():
            node = 0
            for b in text:
                step = self.child.get(node << 8 | b)
                if step is None:
                    step = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = step
            self.token_at[node] = token
        below: list[list[int]] = [[] for _ in self.token_at]
        for at, step in reversed(self.child.items()):
            node = at >> 8
            below[node] += ([self.token_at[step]] if self.token_at[step] >= 0 else []) + below[step]
            if len(below[node]) > WIDE:
                below[node] = [-1] * (WIDE + 1)
        self.below = below

    def _fresh(self) -> None:
        """Forget compiled states; state 0 is the start of a piece."""
        # A state is the last token and three numbers for each running entry, packed.
        start = array("i", [-1]).tobytes()
        self.number = {start: 0}
        self.meaning = [start]
        self.last = np.full(1024, -1, np.int32)
        self.steps = 0
        self._table(12)

    def _table(self, bits: int) -> None:
        """An empty table of transitions: state and byte in one number, or -1; where to, and the change."""
        self.bits = bits
        self.key = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.delta = np.zeros(1 << bits, np.int8)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each transition or the free one where it belongs, and which ones are there."""
        slot = (key.astype(np.uint64) * GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.key[slot]
        off = np.flatnonzero((there != key) & (there >= 0))
        while len(off):
            slot[off] = slot[off] + 1 & (1 << self.bits) - 1
            there[off] = self.key[slot[off]]
            off = off[(there[off] != key[off]) & (there[off] >= 0)]
        return slot, there == key

    def _slot(self, key: int) -> int:
        """The same for one transition; -1 when it is not there."""
        slot = (key * int(GOLDEN) & (1 << 64) - 1) >> 64 - self.bits
        while (there := self.key[slot]) != key:
            if there < 0:
                return -1
            slot = slot + 1 & (1 << self.bits) - 1
        return slot

    def _add(self, key: int, to: int, change: int) -> None:
        if 2 * self.steps >= len(self.key):
            had = self.key >= 0
            keys, nexts, deltas = self.key[had], self.next[had], self.delta[had]
            self._table(self.bits + 1)
            # In rounds: of those that want one free slot the last one gets it.
            left = np.arange(len(keys))
            while len(left):
                slot, _ = self._find(keys[left])
                self.key[slot] = keys[left]
                won = self.key[slot] == keys[left]
                self.next[slot[won]], self.delta[slot[won]] = nexts[left[won]], deltas[left[won]]
                left = left[~won]
        slot = (key * int(GOLDEN) & (1 << 64) - 1) >> 64 - self.bits
        while self.key[slot] >= 0:
            slot = slot + 1 & (1 << self.bits) - 1
        self.key[slot], self.next[slot], self.delta[slot] = key, to, change
        self.steps += 1

    def _forget(self) -> None:
        """Forget the ids of pieces.  A place holds one piece: its bytes, and where its ids are."""
        self.held = np.zeros((2, 1 << PLACES), np.uint64)
        self.place = np.zeros(1 << PLACES, np.int32)
        self.size = np.zeros(1 << PLACES, np.uint8)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the text of two tokens as these two.

        Walks up the merges that build the end of ``a`` and the beginning of
        ``b``, in the order of their ranks; a merge across the seam that comes
        before the next of them would be done instead.  Of equal merges the
        left one goes first.
        """
        known = self.valid.get(a << 32 | b)
        if known is not None:
            return known
        left, right = [(a, NEVER)], [(b, NEVER)]
        while left[-1][0] in self.parts:
            _, x, rank = self.parts[left[-1][0]]
            left.append((x, rank))
        while right[-1][0] in self.parts:
            x, _, rank = self.parts[right[-1][0]]
            right.append((x, rank))
        i, j, known = len(left) - 1, len(right) - 1, True
        while True:
            (x, up), (y, over) = left[i], right[j]
            seam = self.merges.get((x, y), NEVER)
            if seam < up and seam <= over and seam < NEVER:
                known = False
                break
            if i == 0 and j == 0:
                break
            if up <= over and i > 0:
                i -= 1
            else:
                j -= 1
        self.valid[a << 32 | b] = known
        return known

    def _useful(self, node: int, before: int) -> bool:
        """Whether an entry that runs on from ``node`` can follow the token ``before``."""
        known = self.use.get(node << 32 | before + 1)
        if known is None:
            ahead = self.below[node]
            known = len(ahead) > WIDE or (before < 0 and bool(ahead))
            known = known or any(self._fits(before, t) for t in ahead)
            self.use[node << 32 | before + 1] = known
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition of ``state`` on ``byte``, made and noted."""
        packed = array("i", self.meaning[state])
        last, threads = packed[0], packed[1:]
        moved = []
        for node, before, count in (*zip(*[iter(threads)] * 3, strict=True), (0, last, 0)):
            step = self.child.get(node << 8 | byte)
            if step is not None:
                moved.append((step, before, count))
        for node, before, count in moved:
            token = self.token_at[node]
            if token >= 0 and (before < 0 or self._fits(before, token)):
                change = count + 1
                break
        else:
            raise AssertionError("each single byte is in the vocabulary")
        kept = array("i", [token])
        for n, u, c in moved:
            if self._useful(n, u):
                kept.extend((n, u, c - change))
        meaning = kept.tobytes()
        to = self.number.get(meaning)
        if to is None:
            to = self.number[meaning] = len(self.meaning)
            self.meaning.append(meaning)
            if to >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last) // 2, -1, np.int32)])
            self.last[to] = token
        self._add(state << 8 | byte, to, change)
        return to

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings: segments, their text, the id after each (-1: none)."""
        parts: list[str] = []
        owner: list[int] = []
        after: list[int] = []
        for k, text in enumerate(texts):
            at = 0
            if self.split is not None:
                for m in self.split.finditer(text):
                    parts.append(text[at : m.start()])
                    owner.append(k)
                    after.append(self.specials[m[0]])
                    at = m.end()
            parts.append(text[at:] if at else text)
            owner.append(k)
            after.append(-1)
        return parts, np.array(owner, np.int64), np.array(after, np.int64)

    def run(self, parts: list[str], want_states: bool):
        """Bytes, piece starts, and per byte the count change or the state."""
        data, begin, limits = self._cut(parts)
        self._drive(data, begin, want_states)
        return data, begin, limits

    def _cut(self, parts: list[str]):
        """Bytes of the texts, which of them begin a piece (and the end), where each text ends."""
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        starts = piece_starts(points, ends)
        place = np.flatnonzero(data & 0xC0 != 0x80)
        limits = np.append(place, len(data))[ends]
        begin = np.zeros(len(data) + 1, bool)
        begin[place[starts]] = True
        begin[-1] = True
        return data, begin, limits

    def _drive(self, data: np.ndarray, begin: np.ndarray, want_states: bool, stretch: int = STRETCH) -> None:
        if len(self.meaning) > MAX_STATES:
            self._fresh()
        for notes in (self.valid, self.use):
            if len(notes) > MAX_NOTES:
                notes.clear()
        n = len(data)
        self.out = np.zeros(n, np.int32 if want_states else np.int8)
        if not n:
            return
        first = np.flatnonzero(begin)
        lanes = np.unique(first[np.searchsorted(first, np.arange(0, n, stretch))]) if stretch > 1 else first
        lanes = lanes[lanes < n]
        length = np.diff(np.append(lanes, n))
        order = np.argsort(-length, kind="stable")
        at, length = lanes[order].copy(), length[order]
        state = np.zeros(len(at), np.int64)
        active = len(at)
        step = 0
        while active:
            while active and length[active - 1] <= step:
                active -= 1
            if active <= FEW_LANES:
                break
            pos = at[:active] + step
            key = np.where(begin[pos], 0, state[:active]) << 8 | data[pos]
            slot, there = self._find(key)
            if not there.all():
                for k in np.unique(key[~there]).tolist():
                    self.compile(k >> 8, k & 255)
                slot, _ = self._find(key)
            to = self.next[slot]
            self.out[pos] = to if want_states else self.delta[slot]
            state[:active] = to
            step += 1
        for k in range(active):
            s = int(state[k])
            for pos in range(int(at[k]) + step, int(at[k]) + int(length[k])):
                s = 0 if begin[pos] else s
                key = s << 8 | int(data[pos])
                slot = self._slot(key)
                if slot < 0:
                    self.compile(s, key & 255)
                    slot = self._slot(key)
                s = int(self.next[slot])
                self.out[pos] = s if want_states else self.delta[slot]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        found = [self._counts(t) for t in few(texts)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        return [ids for t in few(texts) for ids in self._ids(t)]

    def _counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, after = self._segments(texts)
        data, begin, limits = self._cut(parts)
        first = np.flatnonzero(begin)
        _, size = self._piece_ids(data, first[:-1], np.diff(first))
        total = np.concatenate([[0], np.cumsum(size)])
        each = np.diff(np.concatenate([[0], total[np.searchsorted(first, limits)]])) + (after >= 0)
        return np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        parts, owner, after = self._segments(texts)
        data, begin, limits = self._cut(parts)
        first = np.flatnonzero(begin)
        token, size = self._piece_ids(data, first[:-1], np.diff(first))
        total = np.concatenate([[0], np.cumsum(size)])
        cut = total[np.searchsorted(first, limits)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        for k, to, special in zip(owner.tolist(), cut.tolist(), after.tolist(), strict=True):
            out[k].append(token[at:to])
            if special >= 0:
                out[k].append(np.array([special], np.int32))
            at = to
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _piece_ids(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        place, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        # Up to 15 bytes and their number, as two numbers.
        short = np.flatnonzero(length <= SHORT)
        padded = np.append(data, np.zeros(SHORT + 1, np.uint8))
        eight = np.ndarray(len(data) + SHORT - 6, "<u8", padded, strides=(1,))
        at, n = start[short], length[short]
        low = eight[at] & HEADS[0][n]
        high = eight[at + 8] & HEADS[1][n] | n.astype(np.uint64) << np.uint64(56)
        code = mix(low ^ (high * GOLDEN))
        at = (code >> np.uint64(64 - PLACES)).astype(np.int64)
        same = (self.held[0][at] == low) & (self.held[1][at] == high)
        hit, known = at[same], short[same]
        place[known], size[known] = self.place[hit], self.size[hit]
        fresh = np.flatnonzero(~same)
        new, low, high, code = short[fresh], low[fresh], high[fresh], code[fresh]
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        # Pieces of equal hash and other bytes are read by themselves.
        like = (low[one][which] == low) & (high[one][which] == high)
        todo = np.concatenate([new[one], new[~like], np.flatnonzero(length > SHORT)])
        ids, sizes = self._read(data, start[todo], length[todo])
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(end, np.int32))
        self.pool[self.used : end] = ids
        place[todo] = self.used + np.cumsum(sizes) - sizes
        size[todo] = sizes
        first = new[one][which]
        place[new[like]], size[new[like]] = place[first[like]], size[first[like]]
        pool, self.used = self.pool, end
        if end > KEPT_IDS:
            self._forget()
        else:
            at = (code[one] >> np.uint64(64 - PLACES)).astype(np.int64)
            self.held[0][at], self.held[1][at] = low[one], high[one]
            self.place[at], self.size[at] = place[new[one]], size[new[one]]
        end = np.cumsum(size)
        return pool[np.repeat(place - (end - size), size) + np.arange(end[-1] if len(end) else 0)], size

    def _read(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pieces by the machine, each from its start, and how many each has."""
        end = np.cumsum(length)
        n = int(end[-1]) if len(end) else 0
        data = data[np.repeat(start - (end - length), length) + np.arange(n)]
        begin = np.zeros(n + 1, bool)
        begin[end - length] = begin[-1] = True
        self._drive(data, begin, True, 1)
        token = np.full(n, -1, np.int32)
        pos = np.flatnonzero(begin[1:])
        while len(pos):
            here = self.last[self.out[pos]]
            token[pos] = here
            pos = pos - self.length[here]
            pos = pos[~begin[pos + 1]]
        where = token >= 0
        return token[where], np.diff(np.concatenate([[0], np.cumsum(where)])[np.concatenate([[0], end])])


class Merger(Transducer):
    """The same ids, those of short pieces by doing the merges of all of them side by side.

    Pieces of invented words are new again and again; each would have the
    transducer compile transitions that are not used afterwards.
    """

    def __init__(self, path: str):
        super().__init__(path)
        text = {i: t for t, i in self.vocab.items()}
        self.nothing = max(self.vocab.values()) + 1
        self.byte = np.array([self.vocab[bytes([b])] for b in range(256)], np.int64)
        pairs = np.array(list(self.merges), np.int64).reshape(-1, 2)
        self.rank_of = np.array(list(self.merges.values()), np.int32)
        self.becomes = np.zeros(int(self.rank_of.max(initial=0)) + 1, np.int64)
        self.becomes[self.rank_of] = [self.vocab[text[x] + text[y]] for x, y in self.merges]
        self.pairs = pairs[:, 0] * (self.nothing + 1) + pairs[:, 1]
        # Four places or more for each pair; a place has the number of its pair.
        self.shift = np.uint64(64 - max(10, (4 * len(pairs)).bit_length()))
        self.seat = np.full(1 << 64 - int(self.shift), -1, np.int64)
        self.rank = np.full(len(self.seat), UNRANKED, np.int32)
        left = np.arange(len(pairs))
        slot = self._slots(self.pairs)
        while len(left):
            free = self.seat[slot] < 0
            self.seat[slot[free]] = self.pairs[left[free]]
            won = self.seat[slot] == self.pairs[left]
            self.rank[slot[won]] = self.rank_of[left[won]]
            left, slot = left[~won], slot[~won] + 1 & len(self.seat) - 1

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * GOLDEN >> self.shift).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each two tokens; ``UNRANKED`` where there is none."""
        pair = a * (self.nothing + 1) + b
        slot = self._slots(pair)
        there = self.seat[slot]
        out = np.where(there == pair, self.rank[slot], UNRANKED)
        off = np.flatnonzero((there != pair) & (there >= 0))
        while len(off):
            slot[off] = slot[off] + 1 & len(self.seat) - 1
            there = self.seat[slot[off]]
            met = there == pair[off]
            out[off[met]] = self.rank[slot[off[met]]]
            off = off[~met & (there >= 0)]
        return out

    def _read(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, of, size = [], [], np.zeros(len(start), np.int64)
        # Rows of about the same width are merged together; very long pieces pass the machine.
        for least, most, read in ((0, SHORT, self._merged), (SHORT, MERGED, self._merged), (MERGED, NEVER, super()._read)):
            mine = np.flatnonzero((length > least) & (length <= most))
            if len(mine):
                found, size[mine] = read(data, start[mine], length[mine])
                ids.append(found)
                of.append(np.repeat(mine, size[mine]))
        if len(ids) < 2:
            return ids[0] if ids else np.zeros(0, np.int32), size
        return np.concatenate(ids)[np.argsort(np.concatenate(of), kind="stable")], size

    def _merged(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces: of each, the first of the lowest merges is done, until none is left.

        A row has the tokens of a piece between two columns of nothing; a
        token that a merge takes away becomes nothing and is skipped by the
        numbers of the columns before and after.
        """
        wide = int(length.max()) + 2
        column = np.arange(wide)
        real = (column > 0) & (column <= length[:, None])
        place = np.minimum(start[:, None] + column - 1, len(data) - 1)
        token = np.where(real, self.byte[data[np.maximum(place, 0)]], self.nothing)
        rank = np.full(token.shape, UNRANKED, np.int32)
        both = real[:, :-1] & real[:, 1:]
        rank[:, :-1][both] = self._ranks(token[:, :-1][both], token[:, 1:][both])
        before = np.tile(column - 1, len(start))
        after = np.tile(column + 1, len(start))
        tokens, ranks = token.reshape(-1), rank.reshape(-1)
        row = np.arange(len(start)) * wide
        while len(row):
            best = rank.argmin(1) if len(row) == len(rank) else rank[row // wide].argmin(1)
            at = row + best
            least = ranks[at]
            more = least < UNRANKED
            row, at, least = row[more], at[more], least[more]
            new = self.becomes[least]
            gone = row + after[at]
            far = after[gone]
            tokens[at], tokens[gone], ranks[gone] = new, self.nothing, UNRANKED
            after[at] = far
            before[row + far] = at - row
            ranks[at] = self._ranks(new, tokens[row + far])
            left = row + before[at]
            ranks[left] = self._ranks(tokens[left], new)
        held = token != self.nothing
        return token[held].astype(np.int32), held.sum(1)


def few(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about ``TOGETHER`` characters, so that vectors stay small."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which code points begin a piece; ``ends``: where the texts end."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    before = np.concatenate([[NONE], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [NONE]]).astype(np.uint8)
    edge = ends[(ends > 0) & (ends < n)]
    before[edge] = NONE
    after[ends[ends > 0] - 1] = NONE
    white = (kind == BLANK) | (kind == SPACE)
    white_before = (before == BLANK) | (before == SPACE)
    solid_after = (after != BLANK) & (after != SPACE) & (after != NONE)
    start = np.where(white, ~white_before | solid_after, (before != kind) & (before != BLANK))
    # Short forms after an apostrophe that begins a piece.
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        last = np.searchsorted(ends, quote, "right")
        stop = ends[last]
        look = lambda d: np.where(quote + d < stop, points[np.minimum(quote + d, n - 1)], 0)
        a, b = look(1), look(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        for chosen, size in ((one, 2), (two, 3)):
            q = quote[chosen]
            start[q + 1] = False
            nxt = q + size
            nxt = nxt[nxt < stop[chosen]]
            start[nxt] = True
    start[np.concatenate([[0], edge])] = True
    return start


@lru_cache(4)
def transducer(path: str, merges: bool = False) -> Transducer:
    """The machine of a vocabulary file, compiled once per worker; one that merges new short pieces if wanted."""
    return Merger(path) if merges else Transducer(path)
