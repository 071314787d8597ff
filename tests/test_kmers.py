"""Exact k-mer neighbours and sketches against set arithmetic in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinmat.functions.kmers import kmer_set, set_jaccard, sketch_vectors
from kinmat.operators import kmer_pairs as kp


def kmers(text, k=21):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def brute(docs, k):
    sets = {i: kmers(t, k) for i, t in docs}
    found = {}
    for a in sets:
        for b in sets:
            inter = len(sets[a] & sets[b])
            if a != b and float(inter) > 0.05 * float(len(sets[a]) + len(sets[b])):
                found[a, b] = (inter, inter / len(sets[a] | sets[b]))
    return sets, found


def test_sets_handle_short_and_wide_text(spark):
    texts = ["", "ab", "abc", "abcabcabc", "naïve café\nüber 😀😀 text", "a\r\nb c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", kmer_set(F.col("t"), 3).alias("s")).collect():
        assert len(row.s) == len(set(row.s)) and set(row.s) == kmers(row.t, 3)


def test_row_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "a array<int>, b array<int>")
    assert [r.j for r in df.select(set_jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 0.0, 0.0]


def hot_passage_docs():
    """A passage in most texts, copies of one text, near copies, and subsets."""
    passage = "common passage that everybody quotes"

    def body(n, length):
        parts = (hashlib.sha256(f"{n}-{i}".encode()).hexdigest() for i in range(1 + length // 64))
        return "".join(parts)[:length]

    docs = [(i, body(i, 60 + 37 * (i % 30)) + (passage if i % 3 else "")) for i in range(90)]
    docs += [(100 + i, docs[5][1]) for i in range(40)]
    docs += [(200 + i, docs[7][1] + f" ending {i}") for i in range(10)]
    docs += [(300, passage), (301, passage[:25]), (302, "short"), (303, "")]
    return docs


@pytest.mark.parametrize("source", ["hot", "documents"])
def test_neighbours_are_exact(spark, documents, source, monkeypatch):
    monkeypatch.setattr(kp, "PAIR_GROUP_ROWS", 7)
    if source == "hot":
        docs = hot_passage_docs()
        table = spark.createDataFrame(docs, "id long, text string")
    else:
        table = documents
        docs = [(r.id, r.text) for r in table.collect()]
    sets, expected = brute(docs, 21)
    found = kp.kmer_neighbours(table)
    members = {r.id: r for r in found.members.collect()}
    assert set(members) == set(sets) and all(members[i].size == len(sets[i]) for i in sets)
    pairs = {(r.id_a, r.id_b): (r.inter, r.jaccard) for r in found.pairs.collect()}
    rebuilt = {}
    for a in sets:
        for b in sets:
            ra, rb = members[a].rep_id, members[b].rep_id
            if a == b:
                continue
            if ra == rb:
                if sets[a]:
                    rebuilt[a, b] = (len(sets[a]), 1.0)
            elif (min(ra, rb), max(ra, rb)) in pairs:
                rebuilt[a, b] = pairs[min(ra, rb), max(ra, rb)]
    assert rebuilt == expected
    degree = {r.id: r.degree for r in kp.degrees(found).collect()}
    assert degree == {i: sum(1 for a, _ in expected if a == i) for i in sets}


def test_hot_passage_makes_no_candidates(spark):
    passage = "x marks the spot where everyone copies from"
    docs = [(i, "".join(hashlib.sha256(f"{i}/{n}".encode()).hexdigest() for n in range(20)) + passage) for i in range(50)]
    table = spark.createDataFrame(docs, "id long, text string")
    sets = table.select("id", kmer_set(F.col("text")).alias("kmers")).select("id", F.size("kmers").alias("size"), "kmers")
    classes = kp.shared_classes(sets)
    assert classes.where("df = 50").count() == 50
    assert kp.candidates(classes).count() == 0


def test_sketches(spark):
    dim, scaled, texts = 128, 4, ["the quick brown fox jumps over the lazy dog " * 3, "tiny", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for row in sketch_vectors(df, dim, scaled).collect():
        total, kept = [0] * dim, 0
        for kmer in kmers(texts[row.id]):
            if int(hashlib.md5(kmer.encode()).hexdigest()[:8], 16) < (1 << 32) // scaled:
                kept += 1
                for block in range(dim // 64):
                    bits = int(hashlib.md5(f"{kmer}|{block}".encode()).hexdigest()[16:], 16)
                    for i in range(64):
                        total[64 * block + i] += 2 * (bits >> (63 - i) & 1) - 1
        assert (row.n_kept, row.v) == (kept, total)


def test_sketch_similarity_tracks_the_exact_one(spark, documents):
    """Wide sketches recover the strong pairs, which is what they are for."""
    from kinmat.operators import matrix as mx
    from kinmat.sources.vectors import store_from_vectors

    sketches = sketch_vectors(documents, 2048, 4)
    store = store_from_vectors(sketches.selectExpr("id as idx", "cast(id as string) as acc", "v"), 2048)
    cells = {(r.row_idx, r.col_idx): r.q / 255 for r in mx.all_cells(mx.build_matrix(store)).collect()}
    pairs = [r for r in kp.kmer_neighbours(documents).pairs.where("jaccard > 0.5 and inter > 200").collect()]
    assert pairs and all(abs(cells[r.id_a, r.id_b] - r.jaccard) < 0.2 for r in pairs)
