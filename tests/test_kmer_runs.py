"""Classes of k-mers from minimizer partitions against set arithmetic in Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinmat.operators import kmer_runs as kr


def brute(docs, k):
    """For every text, how many k-mers are in exactly which texts."""
    holders = defaultdict(set)
    for i, text in docs:
        for at in range(len(text or "") - k + 1):
            holders[text[at : at + k]].add(i)
    found = defaultdict(Counter)
    for ids in holders.values():
        for i in ids:
            found[i][len(ids)] += 1
    return found, holders


def texts():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(120))
    docs = []
    for i in range(60):
        body = "".join(rng.choice("abcé漢🙂 \n") for _ in range(rng.randrange(0, 200)))
        docs.append((i * 7 - 100, body + (passage if i % 2 else "") + "xy" * (i % 5) * 20))
    return docs + [(1000, ""), (1001, None), (1002, "short"), (1003, "a" * 500), (1004, "a" * 30)]


@pytest.mark.parametrize("k", [1, 5, 9, 21])
@pytest.mark.parametrize("bounds", [{}, {"chunk_kmers": 40, "group_kmers": 80}, {"hot_kmers": 60}, {"hot_kmers": 200, "chunk_kmers": 40, "group_kmers": 80}])
def test_classes(spark, k, bounds):
    docs = texts()
    rows = kr.kmer_parts(spark.createDataFrame(docs, "id long, text string"), k, **bounds).collect()
    expected, holders = brute(docs, k)
    found = defaultdict(Counter)
    for r in rows:
        found[r["id"]][r["df"]] += r["weight"]
    assert {i: dict(c) for i, c in found.items()} == {i: dict(c) for i, c in expected.items()}
    # What two texts share is what stands under equal classes.
    by_class = defaultdict(Counter)
    for r in rows:
        if r["df"] > 1:
            by_class[r["df"], r["mark_a"], r["mark_b"]][r["id"]] += r["weight"]
        else:
            assert (r["mark_a"], r["mark_b"]) == (0, 0)
    shared, wanted = Counter(), Counter()
    for counts in by_class.values():
        assert len(set(counts.values())) == 1 and all(df == len(counts) for df in [len(counts)])
        for i in counts:
            for j in counts:
                shared[i, j] += counts[i]
    for ids in holders.values():
        if len(ids) > 1:
            for i in ids:
                for j in ids:
                    wanted[i, j] += 1
    assert shared == wanted


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    monkeypatch.setattr(kr, "SLICE_POINTS", 100)
    import pyarrow as pa

    batch = pa.record_batch({"id": pa.array([5]), "text": pa.array([text])})
    pieces = list(kr._slices(iter([batch]), 21))
    assert len(pieces) == 30
    spelled = ["".join(map(chr, p)) for _, p, _ in pieces]
    assert [s[i : i + 21] for s in spelled for i in range(len(s) - 20)] == [text[i : i + 21] for i in range(len(text) - 20)]


def test_minimizers_are_least_hashes():
    points = np.random.default_rng(3).integers(97, 101, 400).astype(np.uint32)
    hashes = kr.window_hashes(points, 9, 2)
    assert (kr.minimizers(points, 21) == [hashes[i : i + 13].min() for i in range(380)]).all()


def test_empty_table(spark):
    assert kr.kmer_parts(spark.createDataFrame([], "id long, text string")).count() == 0
