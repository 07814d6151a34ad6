"""Vector expressions.  Short lists are folded in Catalyst; joins of many vectors are in ``operators.similarity``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a guard against zero vectors; null if a vector is."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def strided(a: Column, size: int) -> Column:
    """Every n-th element, so that ``size`` are left: the compressed trace of a pruned vector."""
    step = F.greatest(F.lit(1), F.floor(F.size(a) / size).cast("int"))
    return F.slice(F.filter(a, lambda x, i: i % step == 0), 1, size)


def phase_gap(a: Column, b: float) -> Column:
    """The distance of two phases on the circle."""
    d = F.abs(a - b)
    return F.when(d > F.pi(), 2 * F.pi() - d).otherwise(d)


def resonance(frequency: float, phase: float) -> Column:
    """Resonance of an oscillator with a drive: none beyond a width that grows with the coupling."""
    c = F.col
    width = 0.15 * c("coupling_strength")
    gap = F.abs(c("natural_frequency") - frequency)
    gauss = F.exp(-gap * gap / (2 * width * width))
    return F.when((gap > width) | (width == 0), 0.0).otherwise(gauss * F.greatest(F.lit(0.0), F.cos(phase_gap(c("phase_offset"), phase))) * c("coupling_strength"))


def _floats(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def floats(c: Column | str) -> Column:
    """The float32 values of a blob, little endian; null if it is null or not whole."""
    return F.pandas_udf(_floats, "array<float>")(c)


def usable(c: Column) -> Column:
    """Whether all values of a vector are finite and not all are zero."""
    return F.coalesce(~F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))
