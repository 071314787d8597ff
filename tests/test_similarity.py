"""The cell rule, as expressions and as kernel."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmat.functions import similarity as sim
from kinmat.operators import kernel

D = 4


def reference(a, b, ni, nj, d=D):
    """Existence, value and cell by exact integer and decimal arithmetic."""
    dot = sum(x * y for x, y in zip(a, b))
    found = float(int(math.trunc(Decimal(dot) / d))) > 0.05 * (ni + nj)
    inter = dot / d
    j = min(1.0, inter / (ni + nj - inter)) if found else None
    q = int(Decimal(j * 255).to_integral_value(ROUND_HALF_UP)) if found else None
    return found, j, q


def norm_sq(v):
    norm = math.sqrt(sum(x * x for x in v) / len(v))
    return norm * norm


CASES = [
    ([0, 0, 0, 0], [0, 0, 0, 0]),
    ([1, 0, 0, 0], [1, 0, 0, 0]),          # norm below 1: not even its own neighbour
    ([2, 2, 2, 2], [2, 2, 2, 2]),
    ([9, -9, 9, -9], [-9, 9, -9, 9]),      # negative product
    ([3, 1, 4, 1], [2, 7, 1, 8]),
    ([100, 0, 0, 0], [5, 0, 0, 0]),        # norms too far apart
    ([100, 0, 0, 0], [6, 0, 0, 0]),
    ([2**30, 1, 1, 1], [2**30, 1, 1, 1]),  # beyond exact doubles
]


def test_expressions_follow_the_rule(spark):
    rows = [(a, b, norm_sq(a), norm_sq(b)) for a, b in CASES]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, ni double, nj double")
    dot, dim = sim.dot(F.col("a"), F.col("b")), F.size("a")
    inter = sim.intersection(dot, dim)
    found = df.select(
        sim.exists(dot, dim, F.col("ni"), F.col("nj")).alias("e"),
        sim.jaccard(inter, F.col("ni"), F.col("nj")).alias("j"),
        sim.quantise(sim.jaccard(inter, F.col("ni"), F.col("nj"))).alias("q"),
    ).collect()
    for row, (a, b, ni, nj) in zip(found, rows):
        exists, j, q = reference(a, b, ni, nj)
        assert row.e == exists
        if exists:
            assert (row.j, row.q) == (j, q)


def test_kernel_follows_the_rule():
    left = np.array([a for a, _ in CASES], dtype=np.int32)
    right = np.array([b for _, b in CASES], dtype=np.int32)
    ls, rs = (np.array([norm_sq(v.tolist()) for v in m]) for m in (left, right))
    expected = {
        (i, j): reference(a, b, ls[i], rs[j])[1]
        for i, a in enumerate(left.tolist()) for j, b in enumerate(right.tolist())
        if reference(a, b, ls[i], rs[j])[0]
    }
    found = {
        (int(i), int(j)): v
        for strip in kernel.existing_cells(left, ls, right, rs, D) for i, j, v in zip(*strip)
    }
    assert found == expected
    every = [c for strip in kernel.every_cell(left, ls, right, rs, D) for c in zip(*strip)]
    assert len(every) == len(CASES) ** 2
    assert {(int(i), int(j)): v for i, j, e, v in every if e} == expected


def test_exact_type_grows_with_the_values():
    small, large, huge = (np.full((1, D), x, dtype=np.int32) for x in (10, 10_000, 2**30))
    assert kernel.exact_dtype(small, small) is np.float32
    assert kernel.exact_dtype(large, large) is np.float64
    assert kernel.exact_dtype(huge, huge) is np.int64


@settings(max_examples=300, deadline=None)
@given(st.floats(-1, 1, allow_nan=False))
def test_rounding_is_half_away_from_zero(j):
    assert kernel.quantise(np.array([j]))[0] == int(Decimal(j * 255).to_integral_value(ROUND_HALF_UP))


@pytest.mark.parametrize("value, q", [(0.5 / 255, 1), (62.5 / 255, 63), (1.0, 255), (0.0526, 13)])
def test_rounding_at_halves(spark, value, q):
    assert spark.range(1).select(sim.quantise(F.lit(value)).alias("q")).first().q == q
    assert kernel.quantise(np.array([value]))[0] == q


def test_nan_and_null_always_differ(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (1.0, 1.0 + 1 / 256), (1.0, 1.1), (None, 1.0), (float("nan"), float("nan"))],
        "a double, b double",
    )
    assert [r.d for r in df.select(sim.differs(F.col("a"), F.col("b")).alias("d")).collect()] == [
        False, False, True, True, True,
    ]
    cells = df.select(sim.requantise(F.col("a")).alias("q")).collect()
    assert [r.q for r in cells] == [255, 255, 255, None, None]
