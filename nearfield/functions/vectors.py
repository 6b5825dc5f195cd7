"""Vector functions as Column expressions.

Arithmetic is in double precision. Up to UNROLL dimensions an expression is written out term
by term, so that it stays within whole-stage code generation; beyond, and where the dimension
isn't known, it is a higher-order function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL = 16
#: Codes are padded to a multiple of this, each pad being the centred code of 0.
LANES = 32
PAD_CODE = -128


def _sum(a: Column, b: Column, dim: int | None, term) -> Column:
    if dim is not None and 0 < dim <= UNROLL:
        return reduce(Column.__add__, (term(F.get(a, F.lit(i)).cast("double"), F.get(b, F.lit(i)).cast("double")) for i in range(dim)))
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(a, b, dim, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(l2_squared(a, b, dim))


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return _sum(a, b, dim, lambda x, y: x * y)


def bounds(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row lo, hi: the padded range of all components; nulls if there is none or it isn't finite.

    NaN components don't count; an infinite one leaves no bounds.
    """
    x = F.col("x")
    parts = vectors.select(F.explode(column).alias("x")).select(x.cast("double").alias("x")).where(~F.isnan("x"))
    low, high = F.min("x"), F.max("x")
    ends = parts.agg(low.alias("low"), high.alias("high"))
    pad = F.greatest((F.col("high") - F.col("low")) * 0.001, F.lit(0.001))
    fine = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
    return ends.select(F.when(fine, F.col("low") - pad).alias("lo"), F.when(fine, F.col("high") + pad).alias("hi"))


def quantise(v: Column, lo: Column, hi: Column) -> Column:
    """Components as codes 0..255 by truncation; NaN is 0, as is all of an empty or infinite range."""
    span = hi - lo
    usable = (span >= 1.1920929e-07) & (span < float("inf"))
    code = lambda x: F.floor(F.least(F.greatest((F.nanvl(x.cast("double"), lo) - lo) * (F.lit(255.0) / span), F.lit(0.0)), F.lit(255.0))).cast("int")
    return F.transform(v, lambda x: F.when(usable, code(x)).otherwise(0))


def centre(codes: Column) -> Column:
    """Codes 0..255 as signed bytes -128..127."""
    return F.transform(codes, lambda x: x - 128)


def padding(dim: int) -> int:
    """What pad lanes add to every product of two centred codes."""
    return (-dim % LANES) * PAD_CODE * PAD_CODE


def code_dot(a: Column, b: Column, dim: int) -> Column:
    return dot(a, b, dim).cast("long") + padding(dim)


def inverse_norm(square: Column) -> Column:
    return F.when(square <= 0, F.lit(0.0)).otherwise(1 / F.sqrt(square.cast("double")))


def routing_distance(product: Column, a_square: Column, b_square: Column) -> Column:
    """1 - cosine of centred codes; 1 if either is zero."""
    a, b = inverse_norm(a_square), inverse_norm(b_square)
    return F.when((a == 0) | (b == 0), F.lit(1.0)).otherwise(1 - product * a * b)


def probe_count(k: Column) -> Column:
    """Buckets probed for k neighbours where nothing else is asked for."""
    return F.least(F.greatest(k * 20, F.lit(50)), F.lit(500))


def default_probes(k: int) -> int:
    return min(max(20 * k, 50), 500)
