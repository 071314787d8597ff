"""Full rows, all pairs and stored-matrix queries against one another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmat.model import VectorStore
from kinmat.operators import allpairs, sampling, scoring
from kinmat.operators import matrix as mx
from kinmat.plans.row_check import diff_runs
from kinmat.sinks.tables import load_matrix, records_to_rows, save_matrix
from kinmat.sources.vectors import store_from_vectors, vectors_from_embeddings


@pytest.fixture(scope="module")
def store(embeddings):
    return vectors_from_embeddings(embeddings, 1000)


@pytest.fixture(scope="module")
def spread_store(spark, embeddings):
    """Norms over several bands, and groups of identical vectors."""
    base = vectors_from_embeddings(embeddings, 10)
    factor = F.pow(F.lit(10), (F.col("idx") % 5)).cast("int")
    scaled = base.vectors.select(
        "idx", "acc", F.when(F.col("idx") < 150, F.array_repeat(F.lit(3), 64)).otherwise(
            F.transform("v", lambda x: x * factor)
        ).alias("v"),
    )
    return store_from_vectors(scaled, 64)


def brute_force(store):
    rows = store.vectors.orderBy("idx").collect()
    idx = [r.idx for r in rows]
    v = np.array([r.v for r in rows], dtype=np.int64)
    n = np.array([r.norm_sq for r in rows])
    dots = v @ v.T
    total = n[:, None] + n[None, :]
    found = np.trunc(dots / store.dim) > 0.05 * total
    inter = dots / store.dim
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.minimum(inter / (total - inter), 1.0)
    q = np.floor(j * 255 + 0.5)
    return {(idx[a], idx[b]): int(q[a, b]) for a, b in zip(*np.nonzero(found))}


def as_dict(df, a, b, value):
    rows = df.select(a, b, value).collect()
    found = {(r[0], r[1]): r[2] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("which", ["store", "spread_store"])
@pytest.mark.parametrize("block_rows", [None, 70])
def test_matrix_has_every_cell_once(request, which, block_rows):
    store = request.getfixturevalue(which)
    cells = mx.all_cells(mx.build_matrix(store, block_rows))
    assert as_dict(cells, "row_idx", "col_idx", "q") == brute_force(store)


def test_bands_lose_nothing_and_pair_less(spread_store):
    plain = VectorStore(spread_store.vectors, spread_store.dim, derived_norms=False)
    banded = allpairs.self_join(spread_store, 50)
    unbanded = allpairs.self_join(plain, 50)
    assert banded.exceptAll(unbanded).count() == 0 and unbanded.exceptAll(banded).count() == 0
    counts = {-1: 100, 0: 100, 3: 100}
    assert allpairs._block_plan(counts, 50) == [(-1, 0, 2, 0, 3), (0, 2, 2, 0, 3), (3, 4, 2, 4, 5)]


@pytest.mark.parametrize("which", ["store", "spread_store"])
def test_broadcast_and_blocked_rows_agree(request, which):
    store = request.getfixturevalue(which)
    queries = sampling.sample_extreme(store.vectors, 40)
    direct = scoring.full_rows(queries, store)
    blocked = scoring.full_rows(queries, store, max_broadcast_bytes=1024)
    chunked = allpairs.block_pairs(queries, store, 30)
    assert direct.count() > 0
    for other in (blocked, chunked):
        assert direct.exceptAll(other).count() == 0 and other.exceptAll(direct).count() == 0
    assert direct.where("row_idx = col_idx").count() == 0


def test_two_partitionings_agree_exactly(store):
    runs = [mx.decoded_rows(mx.build_matrix(store, rows)) for rows in (500, 90)]
    assert diff_runs(store.ids, *runs).count() == 0


def test_copies_are_kept_once(spread_store):
    matrix = mx.build_matrix(spread_store)
    assert matrix.copies.where("rep_idx = 0").count() == 150
    stored = matrix.cells.where("row_idx < 150 or col_idx < 150")
    assert stored.where("row_idx between 1 and 149 or col_idx between 1 and 149").count() == 0
    one = mx.decoded_rows(matrix, spread_store.ids.where("idx = 7")).where("jaccard = 1")
    assert {r.col_idx for r in one.collect()} >= set(range(150))


def test_hot_copies_are_split_without_loss(spark, monkeypatch, spread_store):
    from kinmat.operators import skew

    whole = as_dict(mx.all_cells(mx.build_matrix(spread_store)), "row_idx", "col_idx", "q")
    split = lambda rows, per_task=20: F.greatest(F.lit(1), F.ceil(rows / F.lit(20)).cast("int"))
    monkeypatch.setattr(mx, "salts_for", split)
    assert as_dict(mx.all_cells(mx.build_matrix(spread_store)), "row_idx", "col_idx", "q") == whole
    # A hot key in a grouped join: the threshold is a share of all rows.
    large = spark.range(1000).selectExpr("id", "case when id < 700 then 'hot' else cast(id as string) end k")
    groups = large.groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.join_grouped(large, groups, "k", "n", "id", hot_rows=50)
    assert joined.count() == 1000 and joined.where("n = 700").count() == 700
    assert joined.select("id").distinct().count() == 1000


def test_saved_matrix_answers_like_the_fresh_one(spark, store, tmp_path):
    matrix = mx.build_matrix(store)
    save_matrix(matrix, str(tmp_path))
    loaded = load_matrix(spark, str(tmp_path))
    wanted = sampling.sample_rows(store.vectors, 20).select("idx", "acc")
    a, b = mx.decoded_rows(matrix, wanted), mx.decoded_rows(loaded, wanted)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_slices(store):
    matrix = mx.keep_matrix(mx.build_matrix(store))
    rows, cols = sampling.sample_disjoint(store.ids, 15, 10)
    long = mx.slice_long(matrix, rows, cols)
    assert long.count() == 150
    stored = {k: v / 255 for k, v in as_dict(mx.all_cells(matrix), "row_idx", "col_idx", "q").items()}
    for r in long.collect():
        assert r.cell == stored.get((int(r.row_acc), int(r.col_acc)), 0.0)
    wide = mx.slice_wide(matrix, rows, cols)
    assert wide.count() == 15 and len(wide.columns) == 11
    again = wide.unpivot(["row_acc"], [c for c in wide.columns if c != "row_acc"], "col_acc", "cell")
    assert again.exceptAll(long).count() == 0


def test_top_lists(store):
    decoded = mx.decoded_rows(mx.build_matrix(store))
    top = mx.top_neighbours(decoded, 11).collect()
    assert {r.id for r in top if r["rank"] == 1} == {r.row_acc for r in top}
    multi = mx.top_for_each(decoded, (3, 11))
    assert multi.where("k = 3").count() == 3 * len({r.row_acc for r in top})
    assert multi.where("k = 11").count() == len(top)
    records = mx.neighbour_records(decoded, 11)
    assert records_to_rows(records).count() == len(top)
    first = records.where("id = '5'").first()
    assert first.neighbor_ids[0] == "5" and list(first.jaccard_similarities) == sorted(
        first.jaccard_similarities, reverse=True
    )


def test_long_lists_are_ranked_in_pieces(store):
    from kinmat.operators.skew import first_in_group

    decoded = mx.keep_matrix(mx.build_matrix(store))
    decoded = mx.decoded_rows(decoded)
    order = mx.query_order()
    whole, pieces = (
        first_in_group(decoded, "row_acc", order, 7, "rank", "id", rows) for rows in (10_000, 20)
    )
    assert whole.count() > 0 and whole.exceptAll(pieces).count() == 0 and pieces.exceptAll(whole).count() == 0


def test_vectors_of_the_wrong_length_fail(spark, store):
    broken = store.restrict(store.vectors.withColumn("v", F.slice("v", 1, 63)))
    with pytest.raises(Exception, match="64 values"):
        scoring.full_rows(sampling.sample_rows(store.vectors, 2), broken).count()


def test_slices_and_pair_truth_have_no_bound(spark, embeddings):
    store = vectors_from_embeddings(embeddings, 1000)
    rows, cols = sampling.sample_disjoint(store.vectors, 30, 40)
    whole = scoring.pair_truth(rows, cols, store.dim)
    tiled = scoring.pair_truth(rows, cols, store.dim, max_broadcast_bytes=4 * store.dim * 7)
    assert tiled.count() == 1200 and tiled.exceptAll(whole).isEmpty() and whole.exceptAll(tiled).isEmpty()


def test_a_hot_vector_goes_through_wanted_rows_and_slices(spark, embeddings, monkeypatch):
    from kinmat.operators import skew

    monkeypatch.setattr(skew.salts_for, "__defaults__", (10,))
    first = embeddings.orderBy("vec_id").select("embedding").first()["embedding"]
    same = F.when(F.col("vec_id") % 3 == 0, F.array(*map(F.lit, first))).otherwise(F.col("embedding"))
    store = vectors_from_embeddings(embeddings.where("vec_id < 120").withColumn("embedding", same), 1000)
    matrix = mx.keep_matrix(mx.build_matrix(store))
    wanted = store.ids.where("idx % 2 = 0")
    decoded = mx.decoded_rows(matrix, wanted)
    everything = mx.decoded_rows(matrix)
    expected = everything.join(wanted.select(F.col("acc").alias("row_acc")), "row_acc", "left_semi").select(*decoded.columns)
    assert decoded.count() == expected.count() > 0 and decoded.exceptAll(expected).isEmpty()
    cells = mx.slice_cells(matrix, wanted, store.ids.where("idx % 3 = 0"))
    inside = expected.where("cast(id as int) % 3 = 0").select("row_acc", F.col("id").alias("col_acc"), F.col("jaccard").alias("cell"))
    assert cells.count() == inside.count() > 0 and cells.exceptAll(inside).isEmpty()


def test_settled_tables_are_released(spark, embeddings):
    import os

    from kinmat.session import _run_folder, released, settle

    with released(spark):
        settled = settle(embeddings.limit(3))
        assert settled.count() == 3 and os.listdir(_run_folder(spark).removeprefix("file:"))
    assert not os.path.exists(_run_folder(spark).removeprefix("file:"))


def test_facts_of_rows_come_from_the_stored_triangle(spark, spread_store, store):
    from kinmat.plans import edge_cases, row_check

    for source in (spread_store, store):
        whole = mx.keep_matrix(mx.build_matrix(source))
        # Some self cells and a row are lost, some values moved.
        moved = F.when(F.col("row_idx") % 5 == 2, F.col("q") - 9).otherwise(F.col("q")).cast("smallint")
        cells = whole.cells.where("row_idx <> 3 and col_idx <> 3 and not (row_idx = col_idx and row_idx % 7 = 4)").withColumn("q", moved)
        for matrix in (whole, mx.StoredMatrix(cells, whole.copies, whole.ids)):
            decoded = mx.decoded_rows(matrix)
            for stored, plain in (
                (edge_cases.stored_degree(matrix), edge_cases.neighbour_degree(matrix.ids, decoded)),
                (row_check.check_stored_self_pairs(matrix), row_check.check_self_pairs(matrix.ids, decoded)),
                (row_check.stored_missing_rows(matrix), row_check.missing_rows(matrix.ids, decoded)),
            ):
                assert stored.count() == plain.count()
                assert stored.exceptAll(plain.select(*stored.columns)).isEmpty()


def test_tiles_stream_past_one_slab(store):
    whole = as_dict(mx.all_cells(mx.build_matrix(store)), "row_idx", "col_idx", "q")
    for rows in (7, 60):
        assert as_dict(mx.all_cells(mx.build_matrix(store, rows)), "row_idx", "col_idx", "q") == whole
