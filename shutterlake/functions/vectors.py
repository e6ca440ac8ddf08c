"""Vectors as array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a shorter vector has no direction.
LEAST_NORM = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its length; null without a direction."""
    # One lambda binds the length, so that it is not computed for each element.
    over = lambda n: F.when(n >= LEAST_NORM, F.transform(v, lambda x: x.cast("double") / n))
    return F.element_at(F.transform(F.array(norm(v)), over), 1)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def to_blob(v: Column) -> Column:
    """array<float> to little-endian bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def from_blob(blob: Column) -> Column:
    """Little-endian bytes to array<float>; null if the length is no multiple of 4."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return run(blob)


def half_precision(v: Column) -> Column:
    """The values after a round trip through 16-bit floats, ties to even.

    No Python: Spark does not always evaluate a UDF of nested lambdas, such as unit()."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        # Steps are 2^-10 of the power of two below, 2^-24 at least; exact in doubles.
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))).cast("double"), F.lit(-14.0)) - 10)
        near = F.rint(x / step) * step
        large = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        plain = F.isnan(x) | (x == 0)
        return F.when(plain, x).when(F.abs(x) >= 65520, large).otherwise(near).cast("float")

    return F.transform(v, one)
