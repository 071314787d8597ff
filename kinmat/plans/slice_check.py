"""Cell-by-cell check of a slice against pair truth (Q-1, J-7, J-12, AG-1, AG-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmat.functions.similarity import requantise

# Names of the six verdicts, in report order.
VERDICTS = (
    "should_exist_but_missing",
    "should_not_exist_but_found",
    "value_mismatch",
    "match",
    "both_absent_ok",
    "row_or_col_not_in_slice",
)
PROBLEMS = (VERDICTS[0], VERDICTS[1], VERDICTS[2], VERDICTS[5])


def _members(ids: DataFrame | None, cells: DataFrame, key: str, flag: str) -> DataFrame:
    named = cells.select(key) if ids is None else ids.select(F.col("acc").alias(key))
    return named.groupBy(key).agg(F.lit(True).alias(flag))


def compare_slice(
    truth: DataFrame,
    cells: DataFrame,
    rows: DataFrame | None = None,
    cols: DataFrame | None = None,
) -> DataFrame:
    """One verdict per truth pair.

    ``cells`` is a long slice (row_acc, col_acc, cell). Whether a pair belongs
    to the slice is decided by its row and its column apart; a pair
    inside the slice without a cell counts as 0, so stored cells are enough when
    the id lists ``rows`` and ``cols`` (acc) of the slice are given. NULL and NaN
    count as found and never as equal.
    """
    rows = _members(rows, cells, "row_acc", "has_row")
    cols = _members(cols, cells, "col_acc", "has_col")
    stored = cells.select("row_acc", "col_acc", "cell", F.lit(True).alias("has_cell"))
    joined = (
        truth.join(stored, ["row_acc", "col_acc"], "left")
        .join(rows, "row_acc", "left")
        .join(cols, "col_acc", "left")
    )
    outside = F.col("has_row").isNull() | F.col("has_col").isNull()
    empty = F.col("has_cell").isNull() | F.coalesce(F.col("cell") == 0, F.lit(False))
    expected = F.col("should_exist") == 1
    same = requantise(F.col("cell")).eqNullSafe(F.col("jaccard_quantized"))
    verdict = (
        F.when(outside, VERDICTS[5])
        .when(expected & empty, VERDICTS[0])
        .when(~expected & ~empty, VERDICTS[1])
        .when(expected & same, VERDICTS[3])
        .when(expected, VERDICTS[2])
        .otherwise(VERDICTS[4])
    )
    return joined.select(
        "row_acc", "col_acc", "should_exist", "jaccard_quantized",
        F.when(~outside, F.when(F.col("has_cell").isNull(), F.lit(0.0)).otherwise(F.col("cell"))).alias("cell"),
        verdict.alias("verdict"),
    )


def slice_mismatches(verdicts: DataFrame) -> DataFrame:
    """D11 records of everything that is a problem."""
    detail = (
        F.when(F.col("verdict") == VERDICTS[1], F.concat(F.lit("cell="), F.col("cell").cast("string")))
        .when(
            F.col("verdict") == VERDICTS[2],
            F.concat_ws(
                " ",
                F.concat(F.lit("expected_q="), F.col("jaccard_quantized").cast("string")),
                F.concat(F.lit("decoded_q="), requantise(F.col("cell")).cast("string")),
            ),
        )
    )
    return verdicts.where(F.col("verdict").isin(*PROBLEMS)).select(
        "row_acc", "col_acc", F.col("verdict").alias("issue"), detail.alias("detail")
    )


def slice_summary(verdicts: DataFrame) -> DataFrame:
    """One row: all six counts, zeros included, plus total_problems and pairs."""
    counts = [F.count_if(F.col("verdict") == name).alias(name) for name in VERDICTS]
    problems = sum((F.col(name) for name in PROBLEMS[1:]), F.col(PROBLEMS[0]))
    return verdicts.agg(*counts, F.count(F.lit(1)).alias("total_pairs")).withColumn(
        "total_problems", problems
    )
