"""Hidden Markov language model over words, with exact corpus counts beneath it.

A latent state emits a class of words, the class emits the word.  The most
frequent words are classes of their own, all others share a class with the
words of the same ending, so the model has a fixed size and every word, known
or not, has a probability.  Within a class a word has its share of the training
tokens, and the words never seen have one share together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import WORDS, batches, fold, raw, texts
from loregraph.session import cut_lineage, shuffle_width

FREQUENT, ENDINGS = 8192, 2048
END = FREQUENT + ENDINGS
CLASSES = END + 1
BLOCK_BYTES = 12 << 20
STATES, ROUNDS, SEGMENT = 6, 4, 256
MARKS = b".,!?;:*#$%&|<>\"')]}"


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts as word numbers within their block, and each block's words by bucket.

    Rows of a text: block, bucket -1, doc_id, train, a = numbers.  Rows of
    words: block, bucket, a = words, b = their numbers, c = training counts.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        names = ["block", "bucket", "doc_id", "train", "a", "b", "c"]
        for batch in batches(source, limit=BLOCK_BYTES):
            lists = [t.lower().split() for t in raw(batch.column(1))]
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            number: dict[bytes, int] = {}
            for words in lists:
                for w in dict.fromkeys(words):
                    number.setdefault(w, len(number))
            seqs = [np.fromiter(map(number.__getitem__, x), np.int32, len(x)) for x in lists]
            counts = np.zeros(len(number), np.int64)
            used = [s for s, t in zip(seqs, train, strict=True) if t]
            if used:
                counts += np.bincount(np.concatenate(used), minlength=len(number))
            n = len(seqs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)),
                    pa.array(np.full(n, -1, np.int32)),
                    batch.column(0),
                    pa.array(train),
                    pa.array([s.tobytes() for s in seqs], pa.binary()),
                    pa.nulls(n, pa.binary()),
                    pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
            words = np.array(list(number), object)
            where = (WORDS.of(list(number)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable").astype(np.int32)
            found, start = np.unique(where[order], return_index=True)
            parts = np.split(order, start[1:]) if len(found) else []
            m = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, block)),
                    pa.array(found.astype(np.int32)),
                    pa.nulls(m, pa.int64()),
                    pa.nulls(m, pa.bool_()),
                    pa.array([b" ".join(words[p]) for p in parts], pa.binary()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.array([counts[p].tobytes() for p in parts], pa.binary()),
                ],
                names=names,
            )
            block += 1

    # A missing id has no fold and its text is not learned from.
    read = texts(docs).withColumn("train", F.coalesce(fold(F.col("doc_id")) != 1, F.lit(False)))
    return read.mapInArrow(
        run, "block long, bucket int, doc_id long, train boolean, a binary, b binary, c binary"
    )


def _by_key(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Key and rows of runs of rows with the same first column."""
    now, held = None, []
    for batch in source:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != now:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def _count(blocks: DataFrame) -> DataFrame:
    """Training count of each word, a row per bucket: bucket, words, counts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, {}
        for batch in source:
            for bucket, words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now and total:
                    yield out(now, total)
                    total = {}
                now = bucket
                for w, c in zip(words.split(), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    total[w] = total.get(w, 0) + c
        if total:
            yield out(now, total)

    def out(bucket: int, total: dict[bytes, int]) -> pa.RecordBatch:
        known = {w: c for w, c in total.items() if c}
        return pa.RecordBatch.from_arrays(
            [
                pa.array([bucket], pa.int32()),
                pa.array([b" ".join(known)], pa.binary()),
                pa.array([np.fromiter(known.values(), np.int64, len(known)).tobytes()], pa.binary()),
            ],
            names=["bucket", "words", "counts"],
        )

    return (
        blocks.filter("bucket >= 0")
        .select("bucket", "a", "c")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(run, "bucket int, words binary, counts binary")
    )


class WordClasses(dict):
    """Class of each word: frequent words have their own, others that of their ending."""

    def __init__(self, frequent: list[bytes]):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.size = len(self)

    def __missing__(self, word: bytes) -> int:
        ending = (word.rstrip(MARKS) or word)[-3:]
        return FREQUENT + WORDS[ending] % ENDINGS

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _frequent(counted: DataFrame) -> list[bytes]:
    """The most frequent words: FREQUENT of them at most, ties by the word."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                c = np.frombuffer(counts, np.int64)
                w = np.array(words.split(), object)
                # Of a bucket no more can be among the most frequent of all.
                least = np.partition(c, -FREQUENT)[-FREQUENT] if len(c) > FREQUENT else 0
                top = sorted(np.flatnonzero(c >= least).tolist(), key=lambda i: (-c[i], w[i]))[:FREQUENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[top].tolist(), pa.binary()), pa.array(c[top])], names=["word", "many"]
                )

    rows = (
        counted.select("words", "counts")
        .mapInArrow(run, "word binary, many long")
        .orderBy(F.desc("many"), "word")
        .limit(FREQUENT)
        .collect()
    )
    return [bytes(r["word"]) for r in rows]


def _class_totals(counted: DataFrame, classes: WordClasses) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each class."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in source:
            for words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                k = classes.of(words.split())
                np.add.at(n, k, np.frombuffer(counts, np.int64))
                v += np.bincount(k, minlength=CLASSES)
        has = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has), pa.array(n[has]), pa.array(v[has])], names=["k", "n", "v"]
        )

    rows = (
        counted.select("words", "counts")
        .mapInArrow(run, "k long, n long, v long")
        .groupBy("k")
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        .collect()  # a row per class
    )
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


def _returned(blocks: DataFrame, counted: DataFrame, classes: WordClasses) -> DataFrame:
    """Count and class of each word back to the blocks it came from."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in source:
            out: list[tuple] = []
            for bucket, block, words, numbers, counts in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                if bucket != now:
                    now, known = bucket, {}
                if block is None:
                    known = dict(zip(words.split(), np.frombuffer(counts, np.int64).tolist(), strict=True))
                    continue
                w = words.split()
                c = np.fromiter((known.get(x, 0) for x in w), np.int64, len(w))
                out.append((block, numbers, c.tobytes(), classes.of(w).astype(np.uint16).tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), *[pa.array(x, pa.binary()) for x in cols[1:]]],
                    names=["block", "b", "c", "k"],
                )

    none = F.lit(None)
    rows = blocks.filter("bucket >= 0").select("bucket", "block", "a", "b", F.lit(None).cast("binary").alias("c"))
    table = counted.select(
        "bucket",
        none.cast("long").alias("block"),
        F.col("words").alias("a"),
        none.cast("binary").alias("b"),
        F.col("counts").alias("c"),
    )
    return (
        rows.unionByName(table)
        .repartition("bucket")
        .sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
        .mapInArrow(run, "block long, b binary, c binary, k binary")
    )


class Model:
    """Start, transition and emission probabilities of the latent states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: class by state
        vals, vecs = np.linalg.eig(move.T)
        mix = np.abs(np.real(vecs[:, np.argmax(np.real(vals))]))
        self.between = mix / mix.sum()

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of classes by the scaled forward recursion."""
        size = np.array([len(s) for s in seqs], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([seqs[i] for i in order]).astype(np.int64)
        length = size[order]
        begin = np.cumsum(length) - length
        total = np.zeros(len(seqs))
        a = np.repeat(self.start[None], len(seqs), 0)
        active = int((length > 0).sum())
        for t in range(int(length.max(initial=0))):
            while length[active - 1] <= t:
                active -= 1
            a = a[:active]
            if t:
                a = a @ self.move
            a = a * self.emit[flat[begin[:active] + t]]
            scale = a.sum(1)
            a /= scale[:, None]
            total[:active] += np.log10(scale)
        out = np.empty(len(seqs))
        out[order] = total
        return out

    def counts(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Expected counts (start, moves, emissions) in segments, by forward and backward recursion."""
        k = len(self.start)
        pieces = [(s[i : i + SEGMENT], i == 0) for s in seqs for i in range(0, len(s), SEGMENT)]
        pieces.sort(key=lambda x: -len(x[0]))
        length = np.array([len(p) for p, _ in pieces])
        head = np.array([h for _, h in pieces])
        flat = np.concatenate([p for p, _ in pieces]).astype(np.int64)
        begin = np.cumsum(length) - length
        steps = int(length[0])
        lanes = [int((length > t).sum()) for t in range(steps)]
        alpha = np.empty((len(flat), k))
        scale = np.empty(len(flat))
        a = np.where(head[:, None], self.start, self.between)
        for t in range(steps):
            at = begin[: lanes[t]] + t
            a = a[: lanes[t]] @ self.move if t else a
            a = a * self.emit[flat[at]]
            scale[at] = a.sum(1)
            a /= scale[at][:, None]
            alpha[at] = a
        moves = np.zeros((k, k))
        b = np.ones((0, k))
        for t in range(steps - 1, -1, -1):
            at = begin[: lanes[t]] + t
            new = np.ones((lanes[t], k))
            if len(b):
                nxt = at[: len(b)] + 1
                x = self.emit[flat[nxt]] * b / scale[nxt][:, None]
                moves += alpha[at[: len(b)]].T @ x
                new[: len(b)] = x @ self.move.T
            b = new
            alpha[at] *= b
        emissions = np.stack(
            [np.bincount(flat, weights=alpha[:, s], minlength=CLASSES) for s in range(k)], 1
        )
        return np.concatenate(
            [alpha[begin[head]].sum(0), (moves * self.move).ravel(), emissions.ravel()]
        )


def _summed(rows: DataFrame, make, size: int, limit: int = 1 << 20) -> np.ndarray:
    """Sum over all rows of the vectors that ``make`` gives for batches of sequences."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches(source, "classes", limit):
            total += make([np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()])
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["at", "value"])

    out = np.zeros(size)
    got = (
        rows.mapInArrow(run, "at long, value double")
        .groupBy("at")
        .agg(F.sum("value").alias("value"))
        .toPandas()  # at most ``size`` rows, the size of the model
    )
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out


def _groups(together: np.ndarray, states: int) -> np.ndarray:
    """Which state each of the most frequent words starts with: words that occur together."""
    freq = np.maximum(1.0, np.diag(together))
    tie = together / np.sqrt(np.outer(freq, freq))
    degree = np.maximum(1e-12, tie.sum(0))
    vecs = np.linalg.eigh(tie / np.sqrt(np.outer(degree, degree)))[1]
    x = vecs[:, -states:]
    x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
    centre = [x[0]]
    while len(centre) < states:
        gap = np.min([((x - c) ** 2).sum(1) for c in centre], 0)
        centre.append(x[int(gap.argmax())])
    centre = np.array(centre)
    for _ in range(20):
        near = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.array([x[near == s].mean(0) if (near == s).any() else centre[s] for s in range(states)])
    return near


def train(rows: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: expected counts of all partitions are added, the driver re-estimates."""
    prior = mass / mass.sum()
    probes = 96

    def together(seqs: list[np.ndarray]) -> np.ndarray:
        pieces = [s[i : i + SEGMENT] for s in seqs for i in range(0, len(s), SEGMENT)]
        x = np.zeros((len(pieces), probes))
        row = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        flat = np.concatenate(pieces).astype(np.int64)
        ok = flat < probes
        x[row[ok], flat[ok]] = 1
        return (x.T @ x).ravel()

    near = _groups(_summed(rows, together, probes * probes).reshape(probes, probes), states)
    emit = np.repeat(prior[:, None], states, 1)
    for s in range(states):
        emit[:probes][near != s, s] *= 0.1
    emit /= emit.sum(0)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    model = Model(np.full(states, 1 / states), move, emit)
    for _ in range(rounds):
        size = states + states * states + CLASSES * states
        c = _summed(rows, model.counts, size)
        start = c[:states] + 1.0
        move = c[states : states + states * states].reshape(states, states) + 1.0
        # The prior keeps every class possible in every state.
        emit = c[states + states * states :].reshape(CLASSES, states)
        emit = emit + prior[:, None] * (1.0 + 0.01 * emit.sum(0))
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """log10 probability of every whole text under the model, and under its unigram base.

    Columns: doc_id, held_out (crc32 fold is 1; such texts are not learned
    from), n_tokens and n_known (words in A-Z lower case, and one end),
    train_tokens, base_score, score.  Null and empty texts are the end alone;
    without training texts the base is 0 a token; repeated rows count and are
    scored row by row; an empty table gives an empty result; columns other
    than doc_id and text are ignored.

    Words are counted in their block, then by bucket of words; the counts go
    back to the blocks the same way, so no task and no driver holds the
    vocabulary, and a frequent word moves once per block.  The driver holds
    the model, whose size is fixed.
    """
    spark = docs.sparkSession
    blocks = cut_lineage(_blocks(docs, 16 * shuffle_width(spark)))
    counted = cut_lineage(_count(blocks))
    classes = WordClasses(_frequent(counted))
    n, v = _class_totals(counted, classes)
    ends = blocks.filter("bucket < 0 and train").count()
    n[END], v[END] = ends, min(1, ends)
    tokens, distinct = int(n.sum()), int(v.sum())
    base_total = np.log10(tokens + 0.5 * (distinct + 1))
    class_mass = n + 0.5 * (v + 1)
    inner_total = np.log10(class_mass)

    def join(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, []
        base = inner = kind = known = None
        for batch in source:
            out: list[tuple] = []
            for block, last, b, c, k, doc_id, is_train, a in zip(
                *[x.to_pylist() for x in batch.columns], strict=True
            ):
                if block != now:
                    now, words, base = block, [], None
                if not last:
                    words.append((np.frombuffer(b, np.int32), np.frombuffer(c, np.int64), np.frombuffer(k, np.uint16)))
                    continue
                if base is None:
                    at = np.concatenate([x[0] for x in words]) if words else np.zeros(0, np.int32)
                    count, kind = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint16)
                    if words:
                        count[at] = np.concatenate([x[1] for x in words])
                        kind[at] = np.concatenate([x[2] for x in words])
                    words = []
                    share = np.log10(count + 0.5)
                    base, inner, known = share - base_total, share - inner_total[kind], count > 0
                s = np.frombuffer(a, np.int32)
                out.append(
                    (
                        doc_id,
                        is_train,
                        len(s) + 1,
                        int(known[s].sum()) + int(ends > 0),
                        float(base[s].sum()) + float(np.log10(ends + 0.5) - base_total),
                        float(inner[s].sum()),
                        np.append(kind[s], np.uint16(END)).tobytes(),
                    )
                )
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)],
                    names=["doc_id", "train", "n_tokens", "n_known", "base_score", "inner", "classes"],
                )

    none = lambda t: F.lit(None).cast(t)
    parts = _returned(blocks, counted, classes).select(
        "block", F.lit(False).alias("last"), "b", "c", "k", none("long").alias("doc_id"),
        none("boolean").alias("train"), none("binary").alias("a"),
    )
    seqs = blocks.filter("bucket < 0").select(
        "block", F.lit(True).alias("last"), none("binary").alias("b"), none("binary").alias("c"),
        none("binary").alias("k"), "doc_id", "train", "a",
    )
    found = cut_lineage(
        parts.unionByName(seqs)
        .repartition("block")
        .sortWithinPartitions("block", "last")
        .mapInArrow(
            join,
            "doc_id long, train boolean, n_tokens long, n_known long, base_score double, "
            "inner double, classes binary",
        )
    )
    model = train(found.filter("train").select("classes"), class_mass, states, rounds)

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "classes", 16 << 20):
            seqs = [np.frombuffer(x, np.uint16) for x in batch.column(5).to_pylist()]
            whole = model.log10(seqs) + batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(whole)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    scored = found.select("doc_id", "n_tokens", "n_known", "base_score", "inner", "classes").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
