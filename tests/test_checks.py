"""Every verdict of every check on small hand-made lists."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinmat.plans import edge_cases, row_check, slice_check, topk_check

STEP = 1 / 255
TRUTH = "row_acc string, col_idx long, col_acc string, jaccard_raw double, jaccard_quantized int"
LIST = "row_acc string, col_idx long, id string, jaccard double"


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "acc string")


def truth_of(spark, rows):
    return spark.createDataFrame(
        [(r, i, c, j, int(j * 255 + 0.5)) for i, (r, c, j) in enumerate(rows)], TRUTH
    )


def list_of(spark, rows):
    return spark.createDataFrame([(r, i, c, j) for i, (r, c, j) in enumerate(rows)], LIST)


def test_slice_verdicts(spark):
    truth = spark.createDataFrame(
        [("r", "a", 1, 100), ("r", "b", 1, 100), ("r", "c", 1, 100), ("r", "d", 0, None), ("r", "e", 0, None),
         ("r", "f", 1, 100), ("x", "a", 1, 100), ("r", "z", 0, None), ("r", "g", 1, 100), ("r", "h", 0, None)],
        "row_acc string, col_acc string, should_exist int, jaccard_quantized int",
    )
    nan = float("nan")
    cells = spark.createDataFrame(
        [("r", "a", 100 / 255), ("r", "b", 0.0), ("r", "c", 101 / 255), ("r", "d", 0.0), ("r", "e", 50 / 255),
         ("r", "g", nan), ("r", "h", None), ("s", "f", 100 / 255)],
        "row_acc string, col_acc string, cell double",
    )
    verdicts = slice_check.compare_slice(truth, cells)
    found = {(r.row_acc, r.col_acc): r.verdict for r in verdicts.collect()}
    assert found == {
        ("r", "a"): "match",
        ("r", "b"): "should_exist_but_missing",
        ("r", "c"): "value_mismatch",
        ("r", "d"): "both_absent_ok",
        ("r", "e"): "should_not_exist_but_found",
        ("r", "f"): "should_exist_but_missing",
        ("x", "a"): "row_or_col_not_in_slice",
        ("r", "z"): "row_or_col_not_in_slice",
        ("r", "g"): "value_mismatch",
        ("r", "h"): "should_not_exist_but_found",
    }
    summary = slice_check.slice_summary(verdicts).first().asDict()
    assert summary["total_pairs"] == 10 and summary["total_problems"] == 8
    assert slice_check.slice_mismatches(verdicts).count() == 8
    named = slice_check.compare_slice(truth, cells, ids(spark, "r"), ids(spark, *"abcdefghz"))
    assert {r.verdict for r in named.where("col_acc = 'z'").collect()} == {"both_absent_ok"}
    empty = slice_check.slice_summary(verdicts.where("false")).first().asDict()
    assert set(empty.values()) == {0}


def test_row_mismatches(spark):
    truth = truth_of(spark, [("p", "a", 0.5), ("p", "b", 0.4), ("p", "c", 0.3), ("gone", "a", 0.5), ("only_self", "a", 0.2), ("other", "a", 0.3)])
    decoded = list_of(spark, [
        ("p", "p", 1.0), ("p", "a", 0.5 + STEP / 2), ("p", "c", 0.3 + 2 * STEP), ("p", "d", 0.1),
        ("only_self", "only_self", 1.0), ("fine", "fine", 1.0), ("unasked", "a", 0.2),
    ])
    wanted = ids(spark, "p", "gone", "only_self", "fine", "silent")
    mismatches = row_check.compare_rows(wanted, truth, decoded)
    assert {(r.accession, r.neighbor, r.issue) for r in mismatches.collect()} == {
        ("p", "b", "missing"), ("p", "c", "value_mismatch"), ("p", "d", "extra"),
        ("gone", None, "row_missing"), ("only_self", "a", "missing"),
    }
    summary = row_check.rows_summary(wanted, truth, mismatches).first().asDict()
    assert summary == {
        "rows_checked": 5, "truth_entries": 5, "mismatches": 5, "n_row_missing": 1,
        "n_missing": 2, "n_extra": 1, "n_value_mismatch": 1,
    }
    listed = spark.createDataFrame([("gone",)], "row_acc string")
    again = row_check.compare_rows(wanted, truth, decoded, listed=listed).where("accession = 'gone'")
    assert [(r.neighbor, r.issue) for r in again.collect()] == [("a", "missing")]


def test_self_pairs(spark):
    decoded = list_of(spark, [
        ("ok", "ok", 1.0), ("near", "near", 1 - 1e-7), ("off", "off", 254 / 255), ("none", "a", 0.5), ("nan", "nan", float("nan")),
    ])
    checked = row_check.check_self_pairs(ids(spark, "ok", "near", "off", "none", "nan", "gone"), decoded)
    assert {r.accession: r.status for r in checked.collect()} == {
        "ok": "ok", "near": "ok", "off": "self_not_one", "none": "self_missing", "nan": "self_not_one", "gone": "no_row",
    }
    assert row_check.self_anomalies(checked).count() == 3
    gone = row_check.missing_rows(ids(spark, "ok", "gone"), decoded).collect()
    assert [r.row_acc for r in gone] == ["gone"]


def test_run_differences(spark):
    a = list_of(spark, [("r", "r", 1.0), ("r", "x", 0.5), ("r", "y", 0.4), ("r", "n", float("nan")), ("only", "x", 0.5), ("only", "y", 0.5)])
    b = list_of(spark, [("r", "r", 1.0), ("r", "x", 0.5 + 1e-9), ("r", "z", 0.4), ("r", "n", float("nan")), ("late", "x", 0.5)])
    found = row_check.diff_runs(ids(spark, "r", "only", "late", "silent"), a, b).collect()
    assert {(r.accession, r.neighbor, r.issue) for r in found} == {
        ("r", "x", "value_differs"), ("r", "y", "only_a"), ("r", "z", "only_b"), ("r", "n", "value_differs"),
        ("only", None, "row_only_a"), ("late", None, "row_only_b"),
    }
    assert len(found) == 6


def expected_verdict(truth, listed, present, k):
    """Set-based restatement of the top-k rule for one row."""
    if not present:
        return "fail" if truth else "exact"
    order = sorted(truth, key=lambda t: (-int(t[2] * 255 + 0.5), -t[2], t[0]))
    q = {name: int(raw * 255 + 0.5) for _, name, raw in truth}
    raw = {name: value for _, name, value in truth}
    names = {name for name, _ in listed}
    if len(order) <= k:
        must, tie = set(raw), set()
    else:
        _, edge, edge_raw = order[k - 1]
        near = {n for n in raw if abs(raw[n] - edge_raw) <= STEP}
        must = {n for n in raw if q[n] > q[edge]} - near
        tie = ({n for n in raw if q[n] == q[edge]} | near) - must
    values = dict(listed)
    if must - names or (len(order) <= k and len(names) > len(order)) or names - must - tie:
        return "fail"
    if any(abs(raw[n] - values[n]) > STEP for n in must):
        return "fail"
    return "exact" if names == {t[1] for t in order[:k]} else "tie"


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_verdicts_against_sets(spark, seed):
    rng = random.Random(seed)
    ks = (1, 2, 3, 5, 8)
    truth_rows, list_rows, names = [], [], []
    for n in range(60):
        row = f"row{n:02d}"
        names.append(row)
        size = rng.choice([0, 1, 2, 3, 6, 9])
        values = [rng.choice([0.2, 0.2, 0.201, 0.203, 0.3, 0.5, 0.502]) for _ in range(size)]
        truth_rows += [(row, 100 + i, f"n{i}", v) for i, v in enumerate(values)]
        if rng.random() < 0.1:
            continue
        list_rows.append((row, 0, row, 1.0))
        for i, v in enumerate(values):
            fate = rng.random()
            if fate < 0.05:
                continue
            shift = 3 * STEP if fate > 0.97 else rng.choice([0, 0, STEP / 2, -STEP / 2])
            list_rows.append((row, 100 + i, f"n{i}", int((v + shift) * 255 + 0.5) / 255))
        if rng.random() < 0.1:
            list_rows.append((row, 999, "foreign", rng.choice([0.1, 0.6])))
    truth = spark.createDataFrame(
        [(r, i, c, j, int(j * 255 + 0.5)) for r, i, c, j in truth_rows], TRUTH
    )
    decoded = spark.createDataFrame(list_rows, LIST)
    found = topk_check.check_topk(ids(spark, *names), truth, decoded, ks).collect()
    assert len(found) == len(names) * len(ks)
    by_row = {name: [(i, c, j) for r, i, c, j in truth_rows if r == name] for name in names}
    lists = {name: sorted([(c, j) for r, _, c, j in list_rows if r == name and c != name], key=lambda x: (-x[1], x[0])) for name in names}
    present = {r for r, *_ in list_rows}
    for r in found:
        own = lists[r.accession][: r.k]
        assert r.status == expected_verdict(by_row[r.accession], own, r.accession in present, r.k), r
        assert r.size_ok == (len(own) == min(r.k, len(by_row[r.accession])))
    assert {r.status for r in found} == {"exact", "tie", "fail"}
    # The same lists handed over per k get the same verdicts; these are not cut.
    tops = spark.createDataFrame(
        [(n, k, c, j) for n, k in itertools.product(names, ks) if n in present
         for c, j in [(n, 1.0), *lists[n][:k]]],
        "row_acc string, k int, id string, jaccard double",
    )
    given = topk_check.check_top_function(ids(spark, *names), truth, tops, ks).collect()
    assert {(r.accession, r.k, r.status) for r in given} == {(r.accession, r.k, r.status) for r in found}
    summary = topk_check.topk_summary(spark.createDataFrame(found)).collect()
    assert all(r.n_pass + r.n_fail == len(names) for r in summary)


def test_top_lists_are_taken_as_given(spark):
    truth = truth_of(spark, [("r", "a", 0.5), ("r", "b", 0.4)])
    tops = spark.createDataFrame(
        [("r", 2, c, j) for c, j in [("r", 1.0), ("a", 0.5), ("b", 0.4), ("c", 0.3)]],
        "row_acc string, k int, id string, jaccard double",
    )
    verdict = topk_check.check_top_function(ids(spark, "r"), truth, tops, (2,)).first()
    assert (verdict.status, verdict.reason, verdict.size_ok) == ("fail", "too_many", False)


def test_edge_cases(spark):
    degrees = spark.createDataFrame(
        [(i, f"a{i}", d) for i, d in enumerate([0, 2, 1, 0, 0, 1, 5, 0])], "idx long, acc string, degree long"
    )
    report = edge_cases.find_edge_cases(degrees, 2)
    assert {(r.accession, r.category) for r in report.collect()} == {
        ("a0", "zero_neighbor"), ("a3", "zero_neighbor"), ("a2", "single_neighbor"), ("a5", "single_neighbor"),
        ("a0", "row0"), ("a7", "last_row"),
    }
    assert {r.acc for r in edge_cases.edge_targets(report).collect()} == {"a0", "a2", "a3", "a5", "a7"}
    counts = {r.category: r["count"] for r in edge_cases.category_counts(report).collect()}
    assert counts == {"zero_neighbor": 2, "single_neighbor": 2, "row0": 1, "last_row": 1}
    decoded = list_of(spark, [("a1", "a1", 1.0), ("a2", "a2", 1.0), ("a2", "a1", 0.3)])
    degree = edge_cases.neighbour_degree(degrees.select("idx", "acc"), decoded)
    assert {r.acc: r.degree for r in degree.collect() if r.degree} == {"a2": 1}


def test_split_rows_keep_empty_lists(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 1, 0.5), ("a", "c", 0, None), ("b", "a", 1, 0.5)],
        "row_acc string, col_acc string, should_exist int, jaccard_raw double",
    )
    rows = {(r.row_acc, r.col_acc) for r in edge_cases.split_rows(pairs).collect()}
    assert rows == {("a", "b"), ("b", "a"), ("c", None)}


def test_expectations(spark):
    manifest = spark.createDataFrame(
        [("row0", "row0_marker", "single", None), ("s", "single_neighbor", "base", "s_mut"),
         ("s_mut", "single_neighbor", "mutant", "s"), ("z", "zero_neighbor", "single", None),
         ("n", "near_identical", "base", "n_mut"), ("n_mut", "near_identical", "mutant", "n"),
         ("b", "background", "base", "b_mut"), ("b_mut", "background", "mutant", "b"),
         ("t1", "boundary_threshold", "base", "t1_mut"), ("t2", "boundary_threshold", "base", "t2_mut"),
         ("gone", "zero_neighbor", "single", None), ("wrong", "last_row_marker", "single", None)],
        "accession string, group string, role string, paired_with string",
    )
    degrees = spark.createDataFrame(
        [(0, "row0", 0), (1, "s", 1), (2, "s_mut", 2), (3, "z", 0), (4, "n", 1), (5, "n_mut", 1),
         (6, "b", 1), (7, "b_mut", 0), (8, "t1", 1), (9, "t2", 1), (10, "last", 0)],
        "idx long, acc string, degree long",
    )
    pairs = spark.createDataFrame([("n", "n_mut", 0.9)], "acc string, partner string, jaccard double")
    found = edge_cases.check_expectations(manifest, degrees, pairs).collect()
    assert {(r.check, r.accession): r.status for r in found} == {
        ("single_neighbor", "s"): "OK", ("single_neighbor", "s_mut"): "FAIL", ("zero_neighbor", "z"): "OK",
        ("zero_neighbor", "gone"): "FAIL", ("near_identical", "n"): "OK", ("near_identical", "n_mut"): "FAIL",
        ("background", "b"): "OK", ("background", "b_mut"): "FAIL", ("boundary_threshold", None): "WARN",
        ("row0_marker", "row0"): "OK", ("last_row_marker", "wrong"): "FAIL",
    }
    both = edge_cases.check_expectations(manifest, degrees.withColumn(
        "degree", F.when(F.col("acc") == "t2", 0).otherwise(F.col("degree"))), pairs)
    assert [r.status for r in both.where("check = 'boundary_threshold'").collect()] == ["OK"]
