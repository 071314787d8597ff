"""Samples are distinct, repeatable and of the asked size."""

import pytest

from kinmat.operators import sampling
from kinmat.sources.vectors import vectors_from_embeddings


@pytest.fixture(scope="module")
def vectors(embeddings):
    return vectors_from_embeddings(embeddings, 1000).vectors


def idx(df):
    return [r.idx for r in df.select("idx").collect()]


def test_random_rows(vectors):
    first, again, other = (idx(sampling.sample_rows(vectors, 30, seed)) for seed in (42, 42, 7))
    assert first == again and len(set(first)) == 30 and set(first) != set(other)


def test_disjoint(vectors):
    rows, cols = (idx(df) for df in sampling.sample_disjoint(vectors, 40, 60))
    assert len(rows) == 40 and len(cols) == 60 and len(set(rows) | set(cols)) == 100
    with pytest.raises(ValueError):
        sampling.sample_disjoint(vectors, 300, 201)


def test_extremes(vectors):
    norms = sorted((r.norm, r.idx) for r in vectors.select("norm", "idx").collect())
    assert set(idx(sampling.sample_extreme(vectors, 10))) == {i for _, i in norms[:10] + norms[-10:]}
    with pytest.raises(ValueError):
        sampling.sample_extreme(vectors, 251)


def test_targets(spark):
    store = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "idx long, acc string")
    wanted = spark.createDataFrame([("a",), ("x",), ("a",)], "acc string")
    known, unknown = sampling.resolve_targets(store, wanted)
    assert [(r.idx, r.acc) for r in known.collect()] == [(2, "a")]
    assert [r.acc for r in unknown.collect()] == ["x"]
    with pytest.raises(ValueError):
        sampling.require_targets(known.where("acc = 'x'"))


def test_cap_keeps_store_order(spark):
    report = spark.range(20).selectExpr("20 - id as idx", "case when id % 2 = 0 then 'e' else 'o' end as category")
    kept = sampling.first_per_category(report, 3).collect()
    assert sorted((r.category, r.idx) for r in kept) == [("e", 2), ("e", 4), ("e", 6), ("o", 1), ("o", 3), ("o", 5)]
