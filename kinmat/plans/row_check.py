"""Full-row, self-pair and two-run checks (Q-2, Q-3, Q-6, J-8..J-11, SO-1, SO-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmat.constants import QUANT_STEP, SELF_TOLERANCE
from kinmat.functions.similarity import dequantise, differs
from kinmat.model import StoredMatrix
from kinmat.operators.matrix import row_facts


def _wanted(wanted: DataFrame) -> DataFrame:
    return wanted.select(F.col("acc").alias("row_acc")).distinct()


def present_rows(decoded: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Rows that have any decoded entry, self included, or an empty list.

    ``listed`` (row_acc) names the lists that exist, entries or not; a table of
    entries alone cannot tell an empty list from none.
    """
    rows = decoded.select("row_acc")
    if listed is not None:
        rows = rows.unionAll(listed.select("row_acc"))
    return rows.groupBy("row_acc").agg(F.lit(True).alias("present"))


def compare_rows(
    wanted: DataFrame,
    truth: DataFrame,
    decoded: DataFrame,
    tolerance: float = QUANT_STEP,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Q-3: (accession, neighbor, issue, expected, actual) per disagreement.

    A wanted row without any decoded entry is one ``row_missing`` record with a
    NULL neighbour, and no record at all if its truth is empty too.
    """
    ids = _wanted(wanted)
    expected = truth.join(ids, "row_acc", "left_semi").select(
        "row_acc", F.col("col_acc").alias("id"), F.col("jaccard_raw").alias("expected"),
        F.lit(True).alias("in_truth"),
    )
    own = decoded.join(ids, "row_acc", "left_semi")
    actual = own.where("id <> row_acc").select(
        "row_acc", "id", F.col("jaccard").alias("actual"), F.lit(True).alias("in_decoded")
    )
    issue = (
        F.when(F.col("in_decoded").isNull(), "missing")
        .when(F.col("in_truth").isNull(), "extra")
        .when(differs(F.col("expected"), F.col("actual"), tolerance), "value_mismatch")
    )
    present = present_rows(own, listed)
    # Only disagreements are matched with the presence of their row.
    entries = (
        expected.join(actual, ["row_acc", "id"], "full_outer")
        .withColumn("issue", issue)
        .where("issue is not null")
        .join(present, "row_acc", "left_semi")
        .select(F.col("row_acc").alias("accession"), F.col("id").alias("neighbor"), "issue", "expected", "actual")
    )
    absent = expected.groupBy("row_acc").agg(
        F.lit(None).cast("string").alias("neighbor"),
        F.lit("row_missing").alias("issue"),
        F.lit(None).cast("double").alias("expected"),
        F.lit(None).cast("double").alias("actual"),
    ).join(present, "row_acc", "left_anti").withColumnRenamed("row_acc", "accession")
    return entries.unionByName(absent)


def rows_summary(wanted: DataFrame, truth: DataFrame, mismatches: DataFrame) -> DataFrame:
    """AG-4, AG-9: rows checked, truth entries, mismatches by kind."""
    ids = _wanted(wanted)
    checked = ids.agg(F.count(F.lit(1)).alias("rows_checked"))
    entries = truth.join(ids, "row_acc", "left_semi").agg(F.count(F.lit(1)).alias("truth_entries"))
    kinds = ("row_missing", "missing", "extra", "value_mismatch")
    counts = mismatches.agg(
        F.count(F.lit(1)).alias("mismatches"),
        *[F.count_if(F.col("issue") == kind).alias(f"n_{kind}") for kind in kinds],
    )
    one = F.lit(1).alias("one")
    # Three single-row aggregates side by side.
    return (
        checked.withColumn("one", one).join(entries.withColumn("one", one), "one")
        .join(counts.withColumn("one", one), "one").drop("one")
    )


def check_self_pairs(
    wanted: DataFrame,
    decoded: DataFrame,
    tolerance: float = SELF_TOLERANCE,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Q-2: (accession, self_jaccard, status) for every wanted row.

    ``no_row`` is counted apart and is no failure; ``self_missing`` and
    ``self_not_one`` are.
    """
    own = F.when(F.col("id") == F.col("row_acc"), F.col("jaccard"))
    has_self = F.when(F.col("id") == F.col("row_acc"), 1)
    rows = decoded.groupBy("row_acc").agg(
        F.max(own).alias("self_jaccard"), F.count(has_self).alias("n_self")
    )
    status = (
        F.when(F.col("present").isNull(), "no_row")
        .when(F.coalesce("n_self", F.lit(0)) == 0, "self_missing")
        .when(differs(F.col("self_jaccard"), F.lit(1.0), tolerance), "self_not_one")
        .otherwise("ok")
    )
    known = _wanted(wanted).join(rows, "row_acc", "left")
    return known.join(present_rows(decoded, listed), "row_acc", "left").select(
        F.col("row_acc").alias("accession"), "self_jaccard", status.alias("status")
    )


def check_stored_self_pairs(matrix: StoredMatrix, tolerance: float = SELF_TOLERANCE) -> DataFrame:
    """Q-2 for every row of a stored matrix, from its diagonal; the rows of ``check_self_pairs`` without decoded lists."""
    value = dequantise(F.col("self_q"))
    status = (
        F.when(F.col("n_cells") == 0, "no_row")
        .when(F.col("self_q").isNull(), "self_missing")
        .when(differs(value, F.lit(1.0), tolerance), "self_not_one")
        .otherwise("ok")
    )
    return row_facts(matrix).select(F.col("acc").alias("accession"), value.alias("self_jaccard"), status.alias("status"))


def stored_missing_rows(matrix: StoredMatrix) -> DataFrame:
    """J-11 for a stored matrix: rows without any cell."""
    return row_facts(matrix).where("n_cells = 0").select(F.col("acc").alias("row_acc"))


def self_anomalies(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("status").isin("self_missing", "self_not_one"))


def missing_rows(wanted: DataFrame, decoded: DataFrame) -> DataFrame:
    """J-11: wanted rows without any decoded entry."""
    return _wanted(wanted).join(present_rows(decoded), "row_acc", "left_anti")


def diff_runs(
    wanted: DataFrame,
    a: DataFrame,
    b: DataFrame,
    listed_a: DataFrame | None = None,
    listed_b: DataFrame | None = None,
) -> DataFrame:
    """Q-6: exact comparison of two decoded runs, self entries included.

    Returns (accession, neighbor, issue, value_a, value_b). A row that one run
    lacks altogether is one record with a NULL neighbour.
    """
    ids = _wanted(wanted)
    sides = []
    for run, value in ((a, "value_a"), (b, "value_b")):
        sides.append(
            run.join(ids, "row_acc", "left_semi").select(
                "row_acc", "id", F.col("jaccard").alias(value), F.lit(True).alias(f"in_{value}")
            )
        )
    left, right = sides
    has_a, has_b = (
        present_rows(side, listed).withColumnRenamed("present", name)
        for side, listed, name in ((left, listed_a, "has_a"), (right, listed_b, "has_b"))
    )
    rows = has_a.join(has_b, "row_acc", "full_outer").join(ids, "row_acc", "left_semi")
    unequal: Column = ~F.col("value_a").eqNullSafe(F.col("value_b"))
    issue = (
        F.when(F.col("in_value_b").isNull(), "only_a")
        .when(F.col("in_value_a").isNull(), "only_b")
        .when(unequal | F.isnan("value_a"), "value_differs")
    )
    found = (
        left.join(right, ["row_acc", "id"], "full_outer")
        .withColumn("issue", issue)
        .where("issue is not null")
        .join(rows.where("has_a and has_b"), "row_acc", "left_semi")
    )
    entries = found.select(
        F.col("row_acc").alias("accession"), F.col("id").alias("neighbor"), "issue", "value_a", "value_b"
    )
    lone = rows.where("has_a is null or has_b is null").select(
        F.col("row_acc").alias("accession"),
        F.lit(None).cast("string").alias("neighbor"),
        F.when(F.col("has_a").isNull(), "row_only_b").otherwise("row_only_a").alias("issue"),
        F.lit(None).cast("double").alias("value_a"),
        F.lit(None).cast("double").alias("value_b"),
    )
    return entries.unionByName(lone)
