"""Quality classifier: random Fourier features, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, fold, raw, row_key, texts
from loregraph.llm.rules import CONTINUATION, SYMBOLS, Words
from loregraph.session import cut_lineage

STATISTICS = (
    "log_bytes",
    "log_words",
    "word_length",
    "word_length_spread",
    "symbol_share",
    "symbol_word_share",
    "shout_share",
    "capital_share",
    "exclamation_share",
    "digit_share",
    "stop_share",
    "comma_share",
    "bar_share",
    "markup_share",
    "line_length",
    "dup_line_share",
    "distinct_word_share",
    "echo_share",
    "repeat_two_share",
    "repeat_three_share",
    "top_word_share",
    "short_word_share",
    "byte_entropy",
    "many_byte_share",
)
FOLDS = 4


def statistics(text: list[bytes]) -> np.ndarray:
    """The statistics of each text, a row per text; an empty text gives finite values too."""
    w = Words(text)
    n = len(text)
    size = np.fromiter(map(len, text), np.float64, n)
    points = np.maximum(1, [len(t.translate(None, CONTINUATION)) for t in text])
    count = np.maximum(1, w.count)
    each = np.fromiter((len(x.translate(None, CONTINUATION)) for x in w.vocabulary), np.float64)
    symbol = np.fromiter((x[-1] in SYMBOLS or x[0] in SYMBOLS for x in w.vocabulary), bool)
    loud = np.fromiter((len(x) > 1 and x.isupper() for x in w.vocabulary), bool)
    length = each[w.word] if len(w.word) else np.zeros(0)
    total = np.bincount(w.doc, weights=length, minlength=n) / count
    square = np.bincount(w.doc, weights=length * length, minlength=n) / count
    of = lambda which: np.bincount(w.doc[which], minlength=n) / count
    win = w.windows()
    covered = lambda k: w.cover(at := np.flatnonzero(win[k] >= 0), np.full(len(at), k))
    echo = np.zeros(len(w.word), bool)
    echo[1:] = (w.word[1:] == w.word[:-1]) & (w.doc[1:] == w.doc[:-1])
    key, many = np.unique(w.doc * max(1, len(w.vocabulary)) + w.word, return_counts=True)
    doc = key // max(1, len(w.vocabulary))
    distinct = np.bincount(doc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc, many)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in text]
    n_lines = np.maximum(1, [len(x) for x in lines])
    dup = np.array([len(x) - len(set(x)) for x in lines])
    hist = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in text])
    hist = hist.reshape(n, 256).astype(np.float64)
    p = hist / np.maximum(1, size)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    share = lambda chars: hist[:, list(chars)].sum(1) / points
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(w.count),
            total,
            np.sqrt(np.maximum(0, square - total * total)),
            share(SYMBOLS),
            of(symbol[w.word]) if len(w.word) else np.zeros(n),
            of(loud[w.word]) if len(w.word) else np.zeros(n),
            share(range(65, 91)),
            share(b"!?"),
            share(range(48, 58)),
            share(b"."),
            share(b",;:"),
            share(b"|\t"),
            share(b"<>{}=/\\"),
            np.log1p(points / n_lines),
            dup / n_lines,
            distinct / count,
            of(echo),
            of(covered(2)),
            of(covered(3)),
            top / count,
            of(length <= 2) if len(w.word) else np.zeros(n),
            entropy,
            hist[:, 128:].sum(1) / np.maximum(1, size),
        ]
    )


class Features:
    """Random Fourier features of a Gaussian kernel over scaled statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, number: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), number)) / (width * np.sqrt(len(mean)))
        self.shift = rng.uniform(0, 2 * np.pi, number)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # A statistic far outside what was seen counts as at the edge.
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        r = np.sqrt(2.0 / len(self.shift)) * np.cos(z @ self.w + self.shift)
        return np.column_stack([r, np.ones(len(x))])


def isotonic(position: np.ndarray, mean: np.ndarray, weight: np.ndarray):
    """Pool adjacent violators: knots and the non-decreasing fit at them."""
    blocks: list[list[float]] = []
    for x, y, w in zip(position.tolist(), mean.tolist(), weight.tolist(), strict=True):
        blocks.append([y, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, _, hi = blocks.pop()
            y1, w1, lo, _ = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    return (
        np.array([x for b in blocks for x in b[2:]]),
        np.array([b[0] for b in blocks for _ in range(2)]),
    )


class Model:
    """Everything a score needs; small and of fixed size."""

    def __init__(self, features: Features, weights: np.ndarray, knots: np.ndarray, fit: np.ndarray):
        self.features, self.weights, self.knots, self.fit = features, weights, knots, fit

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.features(x) @ self.weights
        # The uncalibrated score, at a small weight, keeps order within a step.
        return 0.99 * np.interp(f, self.knots, self.fit) + 0.01 / (1 + np.exp(-4 * (f - 0.5)))


def measure(docs: DataFrame) -> DataFrame:
    """Statistics of each text: doc_id, row (a name of id and text), x array<double>."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            x = statistics(raw(batch.column(2)))
            flat = pa.array(x.ravel())
            rows = pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], rows], names=["doc_id", "row", "x"])

    read = texts(docs).select("doc_id", row_key().alias("row"), "text")
    return read.mapInArrow(run, "doc_id long, row long, x array<double>")


def fit(
    measured: DataFrame,
    labels: DataFrame,
    number: int = 192,
    width: float = 0.7,
    ridge: float = 1e-3,
    bins: int = 1024,
    seed: int = 11,
) -> Model:
    """Learn from labelled rows whose crc32 fold is not 0.

    The normal equations are sums over rows: each partition adds up one matrix
    per part of the training rows, Spark adds those, and the driver solves
    systems of fixed size.  A model fitted without a part scores that part;
    these scores, counted in ``bins`` bins, are what calibration sees.
    Labels other than 0 and 1 and rows without a label are not used; several
    labels of a document all count.
    """
    seen = (
        measured.join(
            labels.select(
                F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")
            ).filter(F.col("y").isin(0, 1)),
            "doc_id",
        )
        .filter(fold(F.col("doc_id")) != 0)
        .select("x", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("part"))
    )
    seen = cut_lineage(seen)
    d = len(STATISTICS)
    first = seen.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    if not first["n"]:
        features = Features(np.zeros(d), np.ones(d), number, width, seed)
        return Model(features, np.zeros(number + 1), np.zeros(1), np.full(1, 0.5))
    features = Features(
        np.array([first[f"m{i}"] for i in range(d)]),
        np.maximum(1e-6, [first[f"s{i}"] for i in range(d)]),
        number,
        width,
        seed,
    )

    def partial(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for rows in source:
            f = features(np.stack(rows["x"].to_numpy()))
            both = np.column_stack([f, rows["y"].to_numpy()])
            for part in np.unique(rows["part"]):
                z = both[(rows["part"] == part).to_numpy()]
                sums[part] = sums.get(part, 0) + z.T @ z
        for part, m in sums.items():
            yield pd.DataFrame({"part": part, "row": np.arange(len(m)), "value": list(m)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        value = np.stack(rows["value"].to_numpy()).sum(0)
        return pd.DataFrame({"part": rows["part"][:1], "row": rows["row"][:1], "value": [value]})

    schema = "part long, row long, value array<double>"
    sums = seen.mapInPandas(partial, schema).groupBy("part", "row").applyInPandas(add, schema)
    size = number + 2
    grams = np.zeros((FOLDS, size, size))
    for r in sums.collect():  # FOLDS x size rows of size numbers, whatever the input
        grams[r["part"], r["row"]] = r["value"]

    def solve(g: np.ndarray) -> np.ndarray:
        n = max(1.0, g[-2, -2])
        penalty = np.full(size - 1, ridge * n)
        penalty[-1] = 1e-9
        return np.linalg.solve(g[:-1, :-1] + np.diag(penalty), g[:-1, -1])

    whole = grams.sum(0)
    without = [solve(whole - g) if (whole - g)[-2, -2] else solve(whole) for g in grams]

    def binned(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y = np.zeros(bins), np.zeros(bins)
        for rows in source:
            f = features(np.stack(rows["x"].to_numpy()))
            part = rows["part"].to_numpy()
            s = np.einsum("ij,ij->i", f, np.stack(without)[part])
            b = np.clip(((s + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            n += np.bincount(b, minlength=bins)
            y += np.bincount(b, weights=rows["y"], minlength=bins)
        has = np.flatnonzero(n)
        yield pd.DataFrame({"bin": has, "n": n[has], "y": y[has]})

    held = (
        seen.mapInPandas(binned, "bin long, n double, y double")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        .orderBy("bin")
        .toPandas()  # at most ``bins`` rows
    )
    knots, fitted = isotonic(
        (held["bin"].to_numpy() + 0.5) * 2 / bins - 0.5,
        # Half an observation of each kind keeps probabilities off 0 and 1.
        held["y"].to_numpy() / held["n"].to_numpy(),
        held["n"].to_numpy(),
    )
    return Model(features, solve(whole), knots, fitted)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, by_row: bool = False
) -> DataFrame:
    """Score every whole text: doc_id, held_out, score in 0..1, predicted; ``by_row`` adds row, its ``row_key``.

    Learns from labelled documents whose crc32 fold is not 0; no label,
    language, source or id enters a score.  Null and empty texts get the score
    of their (finite) statistics; without labels every score is 0.5; repeated
    rows are scored row by row and an empty table gives an empty result.
    Columns other than doc_id and text of the documents, doc_id and quality of
    the labels are ignored.  Texts are read once; what is kept is a row of
    two dozen numbers per document.
    """
    measured = cut_lineage(measure(docs))
    model = fit(measured, labels)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            if len(rows):
                score = model.score(np.stack(rows["x"].to_numpy()))
                score = np.clip(score, 0.0, 1.0)
                yield pd.DataFrame({"doc_id": rows["doc_id"], "row": rows["row"], "score": score})

    return measured.mapInPandas(run, "doc_id long, row long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *["row"] * by_row,
    )
