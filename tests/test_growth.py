"""What grows with the square of a store or with candidate pairs: searches keep their rows, facts are summed in tiles, pairs are one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmat.functions.kmers import kmer_set, md5_words, sketch_vectors
from kinmat.operators import allpairs, kmer_pairs, scoring
from kinmat.operators import matrix as mx
from kinmat.plans import stages
from kinmat.registered import queries
from kinmat.session import settle
from kinmat.sources.vectors import store_from_vectors


@pytest.fixture(scope="module")
def store(spark):
    """Vectors of several norms, some of them copies and one zero."""
    rng = np.random.default_rng(3)
    rows = [(i, str(i), [int(x) for x in rng.integers(-3, 9, 8) * 10 ** (i % 3)]) for i in range(90)]
    rows += [(90 + i, str(90 + i), rows[7][2]) for i in range(12)] + [(102, "102", [0] * 8)]
    return store_from_vectors(spark.createDataFrame(rows, "idx long, acc string, v array<int>"), 8)


def same(a, b):
    assert a.count() == b.count() > 0
    assert a.exceptAll(b.select(*a.columns)).isEmpty()


def test_kept_rows_have_all_their_cells(store):
    whole = mx.keep_matrix(mx.build_matrix(store))
    for wanted in ("idx % 10 = 0", "idx in (7, 95, 102)"):
        part = mx.keep_matrix(mx.build_matrix(store, 16), store.ids.where(wanted))
        assert part.cells.count() < whole.cells.count()
        same(mx.decoded_rows(part), mx.decoded_rows(whole, store.ids.where(wanted)))
        cols = store.ids.where("idx % 7 = 0")
        same(mx.slice_cells(part, part.rows, cols), mx.slice_cells(whole, part.rows, cols))
        with pytest.raises(ValueError, match="some of its rows"):
            mx.row_facts(part)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_kept_rows_are_not_shuffled_to_be_named_and_ranked(store):
    # Two sort-merge joins of all cells, and one of all decoded rows in the ranking, before.
    kept = mx.keep_matrix(mx.build_matrix(store), store.ids.where("idx % 10 = 0"))
    decoded = mx.decoded_rows(kept)
    assert "hashpartitioning" not in plan(decoded) and "SortMergeJoin" not in plan(decoded)
    assert "SortMergeJoin" not in plan(mx.slice_cells(kept, kept.rows, store.ids.where("idx % 7 = 0")))
    assert "SortMergeJoin" not in plan(mx.top_neighbours(settle(decoded), 3))


def test_a_subset_check_keeps_the_rows_of_a_run_once(store, monkeypatch):
    kept = []
    monkeypatch.setattr(mx, "touching", lambda *args: kept.append(args) or allpairs.touching(*args))
    matrix, rows = mx.build_matrix(store), store.ids.where("idx in (7, 95, 102)")
    report = stages.check_subset(store, matrix, matrix, rows=rows)
    # Three times before: per run, and for the edge rows among the same rows.
    assert len(kept) == 1 and report.mismatches.isEmpty()


def test_faulty_runs_are_made_as_they_are_asked_for(spark, monkeypatch):
    made, faulty = [], queries._faulty
    monkeypatch.setattr(queries, "_faulty", lambda *args: made.append(args[-1]) or faulty(*args))
    folder = "/root/testdata/sf0.001"
    matrix, a = queries._faulty_runs(spark, folder)
    assert made == [0] and a.count() > 0
    # An added cell stands beside the decoded ones only where they have none.
    assert a.groupBy("row_acc", "id").count().where("count > 1").isEmpty()


def test_facts_are_the_same_from_tiles_and_from_cells(store):
    for block_rows in (None, 9):
        same(mx.row_facts(mx.build_matrix(store, block_rows)), mx.row_facts(mx.keep_matrix(mx.build_matrix(store))))


def test_the_work_of_a_tile_is_bounded():
    # One slab of 250,000 rows before; a tile has at most as many pairs as 16,384 rows give, until there are 20,000 tiles.
    assert allpairs.block_rows_for(1_000_000, 64, 12) == 16_384
    assert allpairs.block_rows_for(2_000, 64, 4) == 1_024
    assert (10**8 / allpairs.block_rows_for(10**8, 64, 12)) ** 2 / 2 <= allpairs._MAX_TASKS


def test_many_queries_are_dealt_to_all_cores_in_bounded_work(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, str(i), [int(x) for x in rng.integers(-3, 9, 8)]) for i in range(600)]
    store = store_from_vectors(spark.createDataFrame(rows, "idx long, acc string, v array<int>"), 8)
    # Eight splits, all rows in one of them: one task compared everything before.
    uneven = store.restrict(store.vectors.repartition(8, F.lit(1)))
    queries = uneven.vectors.where("idx % 2 = 0")
    found = scoring.full_rows(queries, uneven)
    assert found.select(F.spark_partition_id()).distinct().count() == 8
    same(found, scoring.full_rows(queries, store, max_broadcast_bytes=1024))
    monkeypatch.setattr(scoring, "_TASK_PAIRS", 10_000)
    assert scoring.full_rows(queries, uneven).rdd.getNumPartitions() == 24
    # A few queries leave the store in its splits.
    assert "Exchange" not in plan(scoring.full_rows(store.vectors.where("idx < 5"), store).select("row_idx"))


def test_candidate_pairs_are_counted_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh "), 90))
    texts = ["".join(rng.choice(list("abcdefgh "), 160)) + passage[: 15 * (i % 7)] for i in range(60)] + [passage, "", passage[5:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [{t[i : i + 21] for i in range(len(t) - 20)} for t in texts]
    expected = {
        (a, b): len(sets[a] & sets[b])
        for a in range(len(sets)) for b in range(a + 1, len(sets))
        if 20 * len(sets[a] & sets[b]) > len(sets[a]) + len(sets[b])
    }
    monkeypatch.setattr(kmer_pairs, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(kmer_pairs, "COMPARED_ENTRIES", 16)
    pairs = kmer_pairs.kmer_neighbours(docs).pairs
    assert {(r.id_a, r.id_b): r.inter for r in pairs.collect()} == expected and len(expected) > 20


def test_candidates_that_cannot_reach_the_threshold_are_left_out(spark):
    # 30 of 300 k-mers suffice for the smaller text alone, but not beside one of 3,000.
    passage = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 70))
    other = lambda n, seed: "".join(np.random.default_rng(seed).choice(list("ijklmnop"), n))
    docs = spark.createDataFrame([(1, passage + other(270, 2)), (2, passage + other(700, 3) + other(270, 2)[:230])], "id long, text string")
    sets = docs.select("id", kmer_set(F.col("text")).alias("kmers")).select("id", F.size("kmers").alias("size"), "kmers")
    assert kmer_pairs.candidates(kmer_pairs.shared_classes(sets)).count() == 1
    docs = spark.createDataFrame([(1, passage + other(270, 2)), (2, passage + other(3000, 3))], "id long, text string")
    sets = docs.select("id", kmer_set(F.col("text")).alias("kmers")).select("id", F.size("kmers").alias("size"), "kmers")
    assert kmer_pairs.candidates(kmer_pairs.shared_classes(sets)).count() == 0


def test_links_are_summed_in_tiles_without_keeping_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    body = "".join(rng.choice(list("abcdefgh "), 300))
    texts = [body + "".join(rng.choice(list("ijklmnop"), 25)) for _ in range(40)] + [body + " x"] * 3 + ["short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    kept = []

    def counted(df):
        table = settle(df)
        kept.append(table.count())
        return table

    settle = kmer_pairs.settle
    monkeypatch.setattr(kmer_pairs, "settle", counted)
    monkeypatch.setattr(kmer_pairs, "PAIR_GROUP_ROWS", 7)
    degree = {r.id: r.degree for r in kmer_pairs.degrees(kmer_pairs.kmer_neighbours(docs)).collect()}
    assert degree == {i: 42 for i in range(43)} | {43: 0}
    # 820 pairs of different texts exist.
    assert max(kept) < 300


def test_digests_side_by_side():
    import hashlib

    strings = [bytes([i % 256]) * (i % 70) for i in range(300)]
    sizes = np.array([len(x) for x in strings])
    found = md5_words(np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert ["%08x%08x%08x%08x" % tuple(map(int, x)) for x in found] == [hashlib.md5(x).hexdigest() for x in strings]


def test_sketches_shuffle_nothing_and_rows_of_one_id_count_together(spark):
    text = "näher \U0001f600 " + "一二三四五六七八九十" * 3 + "the quick brown fox jumps over the lazy dog"
    rows = [(1, text), (2, None), (None, text), (3, "short")]
    once = {r.id: (r.n_kept, r.v) for r in sketch_vectors(spark.createDataFrame(rows, "id long, text string"), 64, 2).collect()}
    assert once[2] == once[None] == once[3] == (0, [0] * 64) and once[1][0] > 5
    twice = sketch_vectors(spark.createDataFrame([*rows, (1, text)], "id long, text string"), 64, 2).where("id = 1").collect()
    assert [(r.n_kept, r.v) for r in twice] == [(2 * once[1][0], [2 * x for x in once[1][1]])] * 2
    plan = sketch_vectors(spark.createDataFrame(rows, "id long, text string"), 64, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
