"""Searches and checks take every row of their table, in their SQL and in the code, at once or part after part."""

import collections

import duckdb
import numpy as np
import pytest

from kinmat.registered import queries
from kinmat.registered.oracle import ORACLE
from kinmat.session import settle, settled_apart

N = 45
#: Queries of all rows.
WHOLE = (
    "sorted_lists",
    "topk_check_status",
    "topk_check_summary",
    "compare_rows_mismatches",
    "diff_runs_mismatches",
    "faulty_rows_mismatches",
    "faulty_self_status",
    "faulty_topk_status",
    "full_rows_all",
    "neighbour_records",
    "neighbours_rows",
    "neighbours_targets",
    "report_head",
    "stage_subset_mismatches",
    "topk_10",
    "all_pairs_matrix",
    "compare_rows_summary",
    "full_rows_targets",
    "topk_boundary_pools",
    "topk_function_status",
    "topk_function_summary",
    "topk_multi",
)
#: Those that are run here, and the column that names the row of a result, where each has some.
RUN = {
    "topk_check_status": "accession",
    "diff_runs_mismatches": None,
    "faulty_self_status": "accession",
    "full_rows_all": "row_idx",
    "neighbours_rows": "row_acc",
    "neighbours_targets": "row_acc",
    "stage_subset_mismatches": None,
    "topk_10": "row_acc",
    "all_pairs_matrix": "row_idx",
    "full_rows_targets": "row_idx",
    "topk_boundary_pools": "row_acc",
}
#: Those that are run in parts.
PARTS = ["sorted_lists", "report_head", "compare_rows_summary"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors whose numbers are not divisible by 50, of values so small that a coarser scale changes them."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0.03, 0.01, 8)], 0) for i in range(1, N + 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("embeddings", vectors, "vec_id long, embedding array<float>, label int"), ("labels", [(i, 0, 0) for i in range(1, N)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return collections.Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def held_against_sql(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    with duckdb.connect() as sql:
        for table in ("embeddings", "labels"):
            sql.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
        expected = sql.execute(ORACLE[name])
        columns = [c[0] for c in expected.description]
        assert sorted(columns) == sorted(found.columns)
        rows = found.collect()
        assert rows_of(found.columns, rows) == rows_of(columns, expected.fetchall())
    return rows


@pytest.mark.parametrize("name", WHOLE)
def test_the_sql_takes_every_row(name):
    # Rows with a number divisible by 50 only, before.
    assert f"% {queries.SEARCH_EVERY} = 0" not in ORACLE[name]


@pytest.mark.parametrize("name", RUN)
def test_every_row_is_taken(spark, folder, name):
    # No row has a number divisible by 50, so nothing was searched before.
    rows = held_against_sql(spark, folder, name)
    assert rows
    if RUN[name]:
        assert len({r[RUN[name]] for r in rows}) == (N - 1 if "targets" in name else N)


def test_tables_settled_apart_are_deleted(spark):
    made = []

    def make():
        made.append(settle(spark.range(20)))
        return made[0].where("id < 5")

    kept = settled_apart(spark, make)
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made[0].settled_path)


@pytest.mark.parametrize("name", PARTS)
def test_rows_taken_in_parts(spark, folder, name, monkeypatch):
    parts = []
    monkeypatch.setattr(queries, "PART_PAIRS", 1100)
    apart = queries.settled_apart
    monkeypatch.setattr(queries, "settled_apart", lambda *args: parts.append(args) or apart(*args))
    rows = held_against_sql(spark, folder, name)
    assert len(parts) == 2 and rows
    if name == "compare_rows_summary":
        assert rows[0].rows_checked == N and rows[0].truth_entries == N * (N - 1)
