"""Plug-in points for text embedding and token counting.

Models are loaded once per Python worker and fed Arrow batches.  Nothing here
downloads anything: a model that is not installed is reported, not replaced by
a different one under the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.functions.text import word_count

EMBEDDING_DIM = 384
EMBEDDING_MODEL = "all-MiniLM-L6-v2"
BATCH = 64

TokenCounter = Callable[[Column], Column]
Embedder = Callable[[Column], Column]


def word_count_tokens(text: Column) -> Column:
    """Approximate token count: the number of words.  Native and additive."""
    return word_count(text)


def bpe_tokens(encoding: str = "cl100k_base") -> TokenCounter:
    """Exact byte-pair token counter; needs the vocabulary on every worker."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.get_encoding(encoding)
        for text in batches:
            sizes = [len(e) for e in enc.encode_ordinary_batch(text.fillna("").tolist())]
            yield pd.Series(sizes, dtype="int64")

    return count


def zero_embedder(dim: int = EMBEDDING_DIM) -> Embedder:
    """Zero vectors: what is stored while no embedding model is available."""

    def embed(text: Column) -> Column:
        return F.when(text.isNotNull(), F.array_repeat(F.lit(0.0).cast("float"), dim))

    return embed


def sentence_embedder(model_name: str = EMBEDDING_MODEL, batch: int = BATCH) -> Embedder:
    """Sentence-transformer embedder; the package must be on every worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(model_name)
        for text in batches:
            vectors = model.encode(text.fillna("").tolist(), batch_size=batch)
            yield pd.Series(list(np.asarray(vectors, dtype=np.float32)))

    return embed
