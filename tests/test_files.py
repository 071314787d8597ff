"""Every file format, written by hand and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmat.operators import matrix as mx
from kinmat.operators import sampling, scoring
from kinmat.plans import row_check, slice_check, stages
from kinmat.sinks import tables
from kinmat.sources import text, vectors


@pytest.fixture(scope="module")
def folder(tmp_path_factory, embeddings):
    """A store of 500 vectors as files, one of them without any neighbour."""
    path = tmp_path_factory.mktemp("store")
    rows = vectors.vectors_from_embeddings(embeddings, 1000).vectors.orderBy("idx").collect()
    data = np.array([r.v for r in rows], dtype="<i4")
    data[123] = 0
    data.tofile(path / "vectors.bin")
    (path / "dimension.txt").write_text("64\n")
    norms = np.sqrt((data.astype(np.int64) ** 2).sum(axis=1) / 64)
    (path / "vector_norms.txt").write_text("".join(f"acc{i} {n!r}\n" for i, n in enumerate(norms.tolist())))
    return path, data, norms


def test_store_from_files(spark, folder):
    path, data, norms = folder
    store = vectors.open_store(spark, str(path))
    rows = store.vectors.orderBy("idx").collect()
    assert [r.acc for r in rows] == [f"acc{i}" for i in range(500)]
    assert np.array_equal(np.array([r.v for r in rows]), data)
    assert [r.norm_sq for r in rows] == [n * n for n in norms.tolist()]


def test_ranges_and_pushdown(spark, folder, monkeypatch):
    path, data, _ = folder
    monkeypatch.setattr(vectors, "_PARTITION_BYTES", 64 * 4 * 100)
    reader = vectors.Int32VectorReader(str(path / "vectors.bin"), 64)
    assert [(p.start, p.stop) for p in reader.partitions()] == [(i, i + 100) for i in range(0, 500, 100)]
    table = vectors.read_vectors(spark, str(path / "vectors.bin"), 64)
    some = table.where("idx in (3, 499, 700)").collect()
    assert {r.idx: list(r.v) for r in some} == {i: data[i].tolist() for i in (3, 499)}
    assert table.where("idx >= 490 and idx < 495").count() == 5
    reader = vectors.Int32VectorReader(str(path / "vectors.bin"), 64)
    list(reader.pushFilters([vectors.GreaterThanOrEqual(("idx",), 490), vectors.LessThan(("idx",), 495)]))
    assert [(p.start, p.stop) for p in reader.partitions()] == [(490, 495)]


def test_broken_stores_fail(spark, folder, tmp_path):
    path, data, _ = folder
    (tmp_path / "vectors.bin").write_bytes((path / "vectors.bin").read_bytes()[:-8])
    (tmp_path / "dimension.txt").write_text("64")
    (tmp_path / "vector_norms.txt").write_text((path / "vector_norms.txt").read_text())
    with pytest.raises(ValueError, match="whole number"):
        vectors.open_store(spark, str(tmp_path))
    (tmp_path / "vectors.bin").write_bytes((path / "vectors.bin").read_bytes()[: -64 * 4])
    with pytest.raises(ValueError, match="500 norms but 499 vectors"):
        vectors.open_store(spark, str(tmp_path))
    (tmp_path / "dimension.txt").write_text("0\n")
    with pytest.raises(ValueError, match="dimension"):
        vectors.open_store(spark, str(tmp_path))


def test_line_numbers_hold_over_splits(spark, tmp_path):
    lines = [f"name{i} {i}.5" for i in range(20_000)]
    (tmp_path / "norms.txt").write_text("\n\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = vectors.read_norms(spark, str(tmp_path / "norms.txt"))
        assert table.count() == 20_000
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # the splits of a later scan
        assert table.count() == 20_000
        assert table.where("acc <> concat('name', idx) or norm <> idx + 0.5").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_accession_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\n   \nc")
    ids = text.read_accessions(spark, str(tmp_path / "ids.txt"))
    assert [r.acc for r in ids.collect()] == ["a", "b", "c"]
    tables.write_accessions(ids, str(tmp_path / "out"))
    assert sorted(r.acc for r in text.read_accessions(spark, str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_pair_truth_round_trip(spark, folder, tmp_path):
    store = vectors.open_store(spark, str(folder[0]))
    rows, cols = sampling.sample_disjoint(store.vectors, 20, 20)
    truth = scoring.pair_truth(rows, cols, store.dim)
    for csv in (True, False):
        tables.write_pair_truth(truth, str(tmp_path / f"{csv}"), csv)
    assert spark.read.csv(str(tmp_path / "True"), header=True).where("jaccard_quantized = -1").count() > 0
    back = text.read_pair_truth(spark, str(tmp_path / "True"))
    assert back.count() == 400 and back.exceptAll(truth).count() == 0
    (tmp_path / "old.csv").write_text("row_acc,col_acc,should_exist,jaccard_raw\na,b,1,0.5\n")
    with pytest.raises(ValueError, match="jaccard_quantized"):
        text.read_pair_truth(spark, str(tmp_path / "old.csv"))


def test_per_row_files(spark, tmp_path):
    (tmp_path / "a_run.csv").write_text("ID,Jaccard\na,1.0\nb,0.5\n")
    (tmp_path / "b_run.csv").write_text("ID,Jaccard\n")
    (tmp_path / "c.csv").write_text("ID,Jaccard\nz,1.0\n")
    lists = text.read_neighbours(spark, str(tmp_path), "_run.csv")
    assert {(r.row_acc, r.id, r.jaccard) for r in lists.collect()} == {("a", "a", 1.0), ("a", "b", 0.5)}
    assert {r.row_acc for r in text.list_rows(spark, str(tmp_path), "_run.csv").collect()} == {"a", "b"}


@pytest.mark.parametrize("header, end", [(",x,y,1", ""), ("Accession,x,y,1,", ",")])
def test_wide_slice(spark, tmp_path, header, end):
    (tmp_path / "s.csv").write_text(f"{header}\nr1,0.5,0,1.0{end}\nr2,0,,0.25{end}\n")
    cells = text.read_slice(spark, str(tmp_path / "s.csv"))
    assert {(r.row_acc, r.col_acc, r.cell) for r in cells.collect()} == {
        ("r1", "x", 0.5), ("r1", "y", 0.0), ("r1", "1", 1.0), ("r2", "x", 0.0), ("r2", "y", None), ("r2", "1", 0.25),
    }


def test_printed_matrix(spark, tmp_path):
    table = "             c1       c2\nr1     0.505882  0.00000\nr2     0.000000  0.74902\n"
    (tmp_path / "p.txt").write_text(f"Processing row_file: a, col_file: b in m\nQuery completed in 0.1 seconds.\n\n{table}")
    cells = text.read_printed_matrix(spark, str(tmp_path / "p.txt"))
    assert {(r.row_acc, r.col_acc, r.cell) for r in cells.collect()} == {
        ("r1", "c1", 0.505882), ("r1", "c2", 0.0), ("r2", "c1", 0.0), ("r2", "c2", 0.74902),
    }
    (tmp_path / "e.txt").write_text("Query completed in 0.1 seconds.\n\n")
    with pytest.raises(ValueError, match="no table"):
        text.read_printed_matrix(spark, str(tmp_path / "e.txt"))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "accession,group,role,target_jaccard,indel_rate,achieved_true_kmer_jaccard,paired_with\n"
        "z,zero_neighbor,single,,,,\nn,near_identical,base,0.97,0.001,0.968,n_mut\n"
    )
    rows = {r.accession: r for r in text.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows["z"].target_jaccard is None and rows["n"].target_jaccard == 0.97 and rows["n"].paired_with == "n_mut"


def test_reports_leave_nothing_stale(spark, tmp_path):
    path = str(tmp_path / "mismatches")
    report = spark.createDataFrame([("a", "b", "missing")], "accession string, neighbor string, issue string")
    assert not tables.write_mismatches(report.where("false"), path) and not (tmp_path / "mismatches").exists()
    assert tables.write_mismatches(report, path) and spark.read.csv(path, header=True).count() == 1
    assert not tables.write_mismatches(report.where("false"), path)
    assert spark.read.schema(report.schema).csv(path, header=True).count() == 0
    assert tables.report_head(report, ["accession"]).count() == 1
    tables.write_category_report(spark.createDataFrame([("a", "row0")], "accession string, category string"), path)
    assert spark.read.csv(path, header=True).first().category == "row0"


def test_row_lists_keep_empty_rows(spark, folder, tmp_path):
    store = vectors.open_store(spark, str(folder[0]))
    wanted = store.vectors.where("idx in (5, 123)")
    truth = scoring.full_rows(wanted, store)
    tables.write_row_lists(truth, wanted, str(tmp_path / "lists"))
    assert spark.read.parquet(str(tmp_path / "lists/rows")).count() == 2
    saved = spark.read.parquet(str(tmp_path / "lists/lists"))
    assert saved.count() == truth.count() > 0 and saved.where("row_idx = 123").count() == 0
    lists = wanted.select(F.col("acc").alias("row_acc")).join(
        truth.select("row_acc", "col_acc", "jaccard_raw"), "row_acc", "left"
    )
    tables.write_lists_by_row(lists, str(tmp_path / "by_row"))
    entries, rows = text.read_exported_lists(spark, str(tmp_path / "by_row"), "truth_raw")
    expected = lists.where("col_acc is not null")
    assert entries.count() == expected.count() and entries.exceptAll(expected.select(*entries.columns)).isEmpty()
    assert {r.row_acc for r in rows.collect()} == {"acc5", "acc123"}


def test_decoded_export_round_trip(spark, tmp_path):
    records = spark.createDataFrame(
        [("a", ["a", "b"], [1.0, 0.5]), ("b", [], []), ("c d/e", ["x"], [0.25])],
        "id string, neighbor_ids array<string>, jaccard_similarities array<double>",
    )
    tables.write_decoded(records, str(tmp_path / "out"))
    entries, rows = text.read_exported_lists(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, entries.collect())) == [("a", "a", 1.0), ("a", "b", 0.5), ("c d/e", "x", 0.25)]
    assert sorted(r.row_acc for r in rows.collect()) == ["a", "b", "c d/e"]


def test_near_ids_share_a_range(folder):
    reader = vectors.Int32VectorReader(str(folder[0] / "vectors.bin"), 64)
    list(reader.pushFilters([vectors.In(("idx",), (3, 5, 400, 9999))]))
    assert [(p.start, p.stop) for p in reader.partitions()] == [(3, 401)]


def test_an_opened_store_is_scanned_without_a_shuffle(spark, folder):
    store = vectors.open_store(spark, str(folder[0]))
    plan = store.vectors.select("idx", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_all_stages(spark, folder, tmp_path):
    """The whole validation on a store from files, against itself and a faulty copy."""
    store = vectors.open_store(spark, str(folder[0]), derived_norms=True)
    matrix = mx.keep_matrix(mx.build_matrix(store))
    other = mx.build_matrix(store, 100)
    for report in (stages.check_random_pairs(store, matrix, 30, 30), stages.check_extreme_pairs(store, matrix, 15)):
        summary = report.summary.first()
        assert summary.total_problems == 0 and summary.match > 0 and report.mismatches.isEmpty()
    ks = (1, 10, 100, 1000)
    rows = stages.check_full_rows(sampling.sample_rows(store.vectors, 20), store, matrix, ks)
    assert rows.summary.first().mismatches == 0
    assert {r.n_fail for r in rows.topk_summary.collect()} == {0}
    assert rows.top_function.where("status = 'fail'").isEmpty() and rows.top_function.count() == 80
    subset = stages.check_subset(store, matrix, other)
    assert subset.run_differences.isEmpty() and subset.mismatches.isEmpty()
    assert {(r.accession, r.category) for r in subset.edge_cases.collect()} == {
        ("acc123", "zero_neighbor"), ("acc0", "row0"), ("acc499", "last_row"),
    }
    # Cells of one column lost and one row shifted: every check reports it.
    shifted = F.when(F.col("row_idx") == 9, F.col("q") - 5).otherwise(F.col("q")).cast("smallint")
    faulty = matrix.cells.where("col_idx <> 7").withColumn("q", shifted)
    faulty = type(matrix)(faulty, matrix.copies, matrix.ids)
    queries = store.vectors.where("idx in (7, 9, 11)")
    rows = stages.check_full_rows(queries, store, faulty, ks)
    issues = {(r.accession, r.issue) for r in rows.mismatches.collect()}
    assert ("acc9", "value_mismatch") in issues and {i for _, i in issues} <= {"value_mismatch", "missing"}
    selves = row_check.check_self_pairs(queries, mx.decoded_rows(faulty, queries.select("idx", "acc")))
    assert {r.accession: r.status for r in selves.collect()} == {
        "acc7": "self_missing", "acc9": "self_not_one", "acc11": "ok",
    }
    subset = stages.check_subset(store, matrix, faulty)
    assert not subset.run_differences.isEmpty()


def test_wide_slice_round_trip(spark, folder, tmp_path):
    store = vectors.open_store(spark, str(folder[0]))
    matrix = mx.build_matrix(store)
    rows, cols = sampling.sample_disjoint(store.vectors, 12, 9)
    ids = [df.select("idx", "acc") for df in (rows, cols)]
    wide = mx.slice_wide(matrix, *ids)
    tables.write_slice(wide, str(tmp_path / "slice"))
    cells = text.read_slice(spark, str(tmp_path / "slice"))
    verdicts = slice_check.compare_slice(scoring.pair_truth(rows, cols, store.dim), cells)
    summary = slice_check.slice_summary(verdicts).first()
    assert summary.total_problems == 0 and summary.total_pairs == 108
