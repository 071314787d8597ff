"""Stores, per-row lists and printed matrices that are written and read back."""

import os

import pytest
from pyspark.sql import functions as F

from kinmat.sinks import tables
from kinmat.sinks import vectors as written
from kinmat.sources import text
from kinmat.sources.vectors import open_store, read_vectors, record_count, vectors_from_embeddings


def test_store_round_trip(spark, embeddings, tmp_path):
    store = vectors_from_embeddings(embeddings, 1000)
    path = str(tmp_path / "store")
    for rows in (store, store.restrict(store.vectors.where("idx < 50").repartition(3))):  # the second replaces the first
        written.write_store(rows, path)
        again = open_store(spark, path)
        assert again.dim == store.dim
        columns = ["idx", "acc", "norm", "v"]
        a, b = rows.vectors.select(*columns), again.vectors.select(*columns)
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    # Joined by name the parts are the plain file.
    parts = sorted(p for p in os.listdir(f"{path}/vectors.bin") if p.endswith(".vectors"))
    with open(tmp_path / "whole.bin", "wb") as out:
        for p in parts:
            out.write(open(f"{path}/vectors.bin/{p}", "rb").read())
    whole = read_vectors(spark, str(tmp_path / "whole.bin"), store.dim)
    folder = read_vectors(spark, f"{path}/vectors.bin", store.dim)
    assert whole.exceptAll(folder).isEmpty() and record_count(f"{path}/vectors.bin", store.dim) == 50
    assert [r["idx"] for r in folder.where("idx in (3, 49)").orderBy("idx").collect()] == [3, 49]
    assert not [p for p in os.listdir(f"{path}/vectors.bin") if p.startswith("_")]


@pytest.mark.parametrize("wrong", ["idx <> 7", "idx > 0"])
def test_a_store_with_gaps_is_refused(spark, embeddings, tmp_path, wrong):
    store = vectors_from_embeddings(embeddings.where("vec_id < 20"), 1000)
    path = str(tmp_path / "store")
    written.write_store(store, path)
    with pytest.raises(Exception, match="consecutive|follow each other"):
        written.write_store(store.restrict(store.vectors.where(wrong)), path)
    assert record_count(f"{path}/vectors.bin", store.dim) == 20  # what was there is still there


def test_row_files(spark, tmp_path):
    lists = spark.createDataFrame(
        [("a", "x", 0.5), ("a", "y", 0.75), ("b c", "x", 1.0), ("none", None, None)], "row_acc string, id string, jaccard double"
    )
    path = str(tmp_path / "lists")
    for _ in range(2):
        written.write_row_files(lists, path)
    assert sorted(os.listdir(path)) == ["a.csv", "b c.csv", "none.csv"]
    found = text.read_neighbours(spark, path)
    assert sorted(map(tuple, found.collect())) == [("a", "x", 0.5), ("a", "y", 0.75), ("b%20c", "x", 1.0)] or sorted(
        map(tuple, found.collect())
    ) == [("a", "x", 0.5), ("a", "y", 0.75), ("b c", "x", 1.0)]
    assert open(f"{path}/a.csv").read().split()[1].startswith('"y"')  # by falling value
    assert {r["row_acc"].replace("%20", " ") for r in text.list_rows(spark, path).collect()} == {"a", "b c", "none"}
    with pytest.raises(Exception, match="file name"):
        written.write_row_files(lists.withColumn("row_acc", F.lit("a/b")), path)


def test_numbered_lines_of_many_parts(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").select(
        F.when(F.col("id") % 10 == 0, "  ").otherwise(F.col("id").cast("string")).alias("value")
    ).write.text(path)
    rows = text.numbered_lines(spark, path).orderBy("line").collect()
    assert [(r["line"], int(r["value"])) for r in rows] == list(enumerate(i for i in range(1000) if i % 10))


def test_printed_matrix_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("r2", 0.1, 1 / 3), ("r1", 0.0, 1.0)], "row_acc string, c1 double, c10 double")
    path = str(tmp_path / "printed")
    tables.write_printed_matrix(wide, path)
    rows = sorted(map(tuple, text.read_printed_matrix(spark, path).collect()))
    assert rows == [("r1", "c1", 0.0), ("r1", "c10", 1.0), ("r2", "c1", 0.1), ("r2", "c10", 1 / 3)]
