"""Similarity as Column expressions (SIM-1, SIM-3..SIM-10, PF-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmat.constants import EXIST_FRACTION, QUANT_LEVELS, QUANT_STEP


def _double(value: float) -> Column:
    return F.lit(float(value)).cast("double")


def dot(a: Column, b: Column) -> Column:
    """SIM-1: integer dot product, accumulated in 64 bits."""
    products = F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint"))
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda total, p: total + p)


def norm_of(v: Column) -> Column:
    """Norm in the store's own unit: sqrt(sum of squares / dimension)."""
    squares = F.aggregate(
        v, F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint") * x.cast("bigint")
    )
    return F.sqrt(squares.cast("double") / F.size(v).cast("double"))


def squared(norm: Column) -> Column:
    """SIM-3."""
    return norm * norm


def intersection(dot_product: Column, dim: Column) -> Column:
    """SIM-4: full precision."""
    return dot_product.cast("double") / dim.cast("double")


def exists(dot_product: Column, dim: Column, row_sq: Column, col_sq: Column) -> Column:
    """PF-1: quotient truncated toward zero, strictly above the threshold."""
    truncated = F.call_function("div", dot_product, dim.cast("bigint"))
    return truncated.cast("double") > _double(EXIST_FRACTION) * (row_sq + col_sq)


def jaccard(inter: Column, row_sq: Column, col_sq: Column) -> Column:
    """SIM-5 and SIM-6; only meaningful where the pair exists."""
    rest = row_sq + col_sq - inter
    return F.when(rest == _double(0), _double(1)).otherwise(
        F.least(F.try_divide(inter, rest), _double(1))
    )


def quantise(value: Column) -> Column:
    """SIM-7: round half away from zero."""
    return F.round(value * _double(QUANT_LEVELS)).cast("int")


def dequantise(q: Column) -> Column:
    """SIM-8."""
    return q.cast("double") / _double(QUANT_LEVELS)


def requantise(cell: Column) -> Column:
    """SIM-9: NULL for NULL and NaN cells, which never match anything."""
    return F.when(~F.isnan(cell), F.round(cell * _double(QUANT_LEVELS)).cast("int"))


def differs(a: Column, b: Column, tolerance: float = QUANT_STEP) -> Column:
    """SIM-10: NULL and NaN always differ."""
    broken = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    return broken | (F.abs(a - b) > _double(tolerance))
