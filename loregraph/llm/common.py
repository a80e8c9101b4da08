"""What the operators share: input columns, batches of bounded size, bit hashes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.session import ship

# Bytes of text worked on at a time in a task; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Id and text of the documents; a null text counts as empty.

    Other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def row_key() -> Column:
    """A 64-bit name of a row by its id and text; a null text counts as empty."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


@lru_cache(1)
def give_back() -> None:
    """Let a worker return the memory of large freed vectors at once.

    Workers are used again for later stages; what an allocator keeps for them
    counts against the executor.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # from this size on, a mapping of its own
        libc.mallopt(-1, 8 << 20)  # the end of the heap goes back from this size on
    except (OSError, AttributeError):  # another C library
        pass


def batches(
    source: Iterable[pa.RecordBatch],
    size: str = "text",
    limit: int = BATCH_BYTES,
    tokenizes: bool = False,
) -> Iterator[pa.RecordBatch]:
    """Cut and join record batches so that each has about ``limit`` bytes in column ``size``.

    The tables of a tokenizer that an earlier stage left in the worker are
    dropped unless this stage ``tokenizes``, too.
    """
    give_back()
    machines = sys.modules.get("loregraph.llm.bpe")
    if machines is not None and not tokenizes:
        machines.transducer.cache_clear()
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in source:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(size))
        each = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(each[at:], dtype=np.int64) + have
            n = int(np.searchsorted(total, limit)) + 1
            part = batch.slice(at, n)
            held.append(part)
            have = int(total[part.num_rows - 1])
            at += part.num_rows
            if have >= limit:
                yield _joined(held)
                held, have = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit function of 64-bit values (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """64-bit hashes of words, the usual ones kept."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHash()
