"""MAP vector algebra on array columns: bind, bundle, unbind, dot products and cosines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(a, b) -> Column:
    """Element-wise product."""
    return F.zip_with(a, b, lambda x, y: x * y)


#: Bipolar keys are their own inverse.
unbind = bind


def bundle(a, b) -> Column:
    """Element-wise sum, without a sign."""
    return F.zip_with(a, b, lambda x, y: x + y)


def difference(a, b) -> Column:
    """Element-wise difference, for updates of a bundle."""
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a, b) -> Column:
    """Integer dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(dots, norm_a, norm_b) -> Column:
    """Cosine from an integer dot product and squared lengths."""
    return dots / (F.sqrt(norm_a.cast("double")) * F.sqrt(norm_b.cast("double")))


def packed_dot(a, b, dimension: int) -> Column:
    """Dot product of two bipolar vectors packed in words: coordinates less twice the differing ones."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.lit(dimension) - 2 * differing).cast("long")


def reverse_scored(raw, key) -> Column:
    """A 1..5 answer in its factor's direction; its own inverse."""
    return F.when(key == "-", 6 - raw).otherwise(raw)
