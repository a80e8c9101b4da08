"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loregraph.llm.bpe import transducer
from loregraph.llm.common import batches, raw, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocab: str | None = None, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of each whole text, and whether it has over ``limit`` tokens.

    ``vocab``: path of a byte-level BPE file of the tokenizers library, found
    on each worker through its package when None.  The counts are those of the
    library: special strings inside a text are one token each, nothing is
    added, cut or padded.  Null and empty texts have no tokens, repeated rows
    are counted row by row, an empty table gives an empty result, and columns
    other than doc_id and text are ignored.  No shuffle: the machine's tables
    are compiled in the workers, which see one batch of texts at a time.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocab or vocabulary())
        for batch in batches(source, tokenizes=True):
            text = raw(batch.column(1))
            counts = machine.counts([t.decode("utf-8", "replace") for t in text])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in text], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(counts > limit, pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
