"""Vector expressions on ARRAY<FLOAT> columns.

They stay inside the JVM.  Use them for one query vector against many rows and
for the codecs; batches of queries go through ``operators.similarity``, which
multiplies blocks of vectors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT8_LIMIT = 127


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, p: acc + p,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine_from(dot_ab: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two vectors from their parts; 0.0 when one is the zero vector."""
    scale = norm_a * norm_b
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot_ab / scale)


def cosine(a: Column, b: Column) -> Column:
    return cosine_from(dot(a, b), norm(a), norm(b))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def quantize_int8(a: Column) -> Column:
    """Scale to [-127, 127] by the largest magnitude, round half to even."""
    top = max_abs(a).cast("double")
    scale = (F.lit(float(INT8_LIMIT)) / top).cast("float")
    return F.when(
        top == 0.0, F.transform(a, lambda x: F.lit(0).cast("tinyint"))
    ).otherwise(F.transform(a, lambda x: F.rint(x * scale).cast("tinyint")))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("float") / F.lit(float(INT8_LIMIT)).cast("float")).cast(
        "array<float>"
    )


def quantize_ternary(a: Column) -> Column:
    """-1, 0 or 1 by comparing with the mean magnitude (strictly)."""
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x).cast("double"))
    mean = total / F.size(a)
    return F.transform(
        a,
        lambda x: F.when(x.cast("double") > mean, F.lit(1))
        .when(x.cast("double") < -mean, F.lit(-1))
        .otherwise(F.lit(0))
        .cast("tinyint"),
    )


def encode(a: Column, bits: Column) -> Column:
    """Quantised codes for 8- and 2-bit rows, NULL for 32-bit rows."""
    return F.when(bits == 8, quantize_int8(a)).when(bits == 2, quantize_ternary(a))


def decode(q: Column, bits: Column) -> Column:
    """Floats from stored codes: int8 is scaled back by 127, ternary is not."""
    return F.when(bits == 8, dequantize_int8(q)).when(bits == 2, q.cast("array<float>"))


def pack(a: Column, bits: Column) -> Column:
    """Codes of a vector that already has the values of its precision.

    Not the same as ``encode``: quantising twice would change a ternary
    vector, packing loses nothing.
    """
    scaled = F.transform(a, lambda x: F.rint(x * F.lit(float(INT8_LIMIT))).cast("tinyint"))
    return F.when(bits == 8, scaled).when(bits == 2, F.transform(a, lambda x: x.cast("tinyint")))


def requantize(a: Column, bits: Column) -> Column:
    """The values a vector has after being stored at the given precision."""
    return F.when(bits == 32, a).otherwise(decode(encode(a, bits), bits))


def check_bits(bits: int) -> None:
    if bits not in (32, 8, 2):
        raise ValueError(f"precision must be 32, 8 or 2 bits, got {bits}")
