import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinmat.llm import fingerprints as fp

TEXTS = ["alpha beta gamma delta", "", "  ", None, "one", "🙂🙂 four é", "alpha beta gamma delta", "tie tie tie tie", "word " * 30_000, "a\x0bb\x1cc d"]


def plain_votes(spark, text):
    words = __import__("re").split(r"[\x20\x09-\x0D]+", text.lower().strip(" \t\n\x0b\x0c\r"))
    rows = [(w, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words)]
    hashed = spark.createDataFrame(rows, "a string, b string").select(F.xxhash64("a", "b").alias("h")).select("h", F.xxhash64("h").alias("l")).collect()
    out = 0
    for name in ("h", "l"):
        for b in reversed(range(64)):
            out = out << 1 | (2 * sum(r[name] >> b & 1 for r in hashed) > len(hashed))
    return f"{out:032x}"


def test_edited_fingerprints(spark):
    rows = [(i * 3, t, 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    found = fp.with_next(fp.edited_fingerprints(docs))
    got = {
        r["doc_id"]: r
        for r in found.select("*", fp.hex_digits("fp_high", "fp_low").alias("own"), fp.hex_digits("edited_high", "edited_low").alias("edited"), fp.hex_digits("next_high", "next_low").alias("next")).collect()
    }
    assert len(got) == len(rows)
    texts = [t or "" for t in TEXTS]
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i * 3]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) < 1000:
            assert r["own"] == plain_votes(spark, text)
            assert r["edited"] == plain_votes(spark, edited)
        assert r["next"] == got[(i + 1) % len(texts) * 3]["own"]
    assert got[0]["own"] == got[18]["own"]


def test_null_repeated_and_single_rows(spark):
    rows = [(None, "null id first"), (5, "twice here"), (5, "twice here"), (8, "last one of them")]
    found = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["next_k"]) for r in found) == [(0, 5), (5, 8), (5, 8), (8, fp.NULL_KEY)]
    assert found and len({r["fp_high"] for r in found if r["doc_id"] == 5}) == 1
    one = fp.edited_fingerprints(spark.createDataFrame([(1, "only one")], "doc_id long, text string"))
    r = fp.with_next(one).collect()[0]
    assert r["next_k"] == 1 and (r["next_high"], r["next_low"]) == (r["fp_high"], r["fp_low"])
    assert fp.edited_fingerprints(one.select("doc_id", F.lit("").alias("text")).limit(0)).collect() == []


def test_next_keys_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "ORDERED_TOGETHER", 7)
    rng = random.Random(2)
    keys = sorted(rng.sample(range(-1000, 1000), 100))
    got = {r["k"]: r["next_k"] for r in fp.next_keys(spark.createDataFrame([(k,) for k in keys], "k long")).collect()}
    assert got == dict(zip(keys, keys[1:] + keys[:1]))


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_search_finds_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(60)]
    for x in prints[:30]:
        for n in range(1, 8):
            for b in rng.sample(range(128), n):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))

    def halves(x):
        return tuple(h - (1 << 64) if h >= 1 << 63 else h for h in (x >> 64, x & (1 << 64) - 1))

    frame = spark.createDataFrame([halves(x) for x in prints], "fp_high long, fp_low long")
    queries = spark.createDataFrame([halves(x) for x in prints[::3]], "fp_high long, fp_low long")
    got = sorted(tuple(r) for r in fp.within_radius(queries, frame, radius).collect())
    expected = sorted(
        (*halves(a), *halves(b), (a ^ b).bit_count()) for a in prints[::3] for b in prints if 0 < (a ^ b).bit_count() <= radius
    )
    assert got == expected
    with pytest.raises(ValueError):
        fp.block_tables(frame, 2)


def test_near_documents_count_copies(spark):
    rows = [(0, 0, 0), (0, 0, 1), (1, 0, 2), (7, 0, 3), (255, 0, 4), (255, 0, 50)]
    frame = spark.createDataFrame(rows, "fp_high long, fp_low long, doc_id long")
    got = {r["fp_high"]: r["n_near"] for r in fp.near_documents(frame, F.col("doc_id") % 50 == 0).collect()}
    assert got == {0: 4, 255: 2}


def test_likeness(spark):
    frame = spark.createDataFrame([(0, 0), (-1, -1), (0, -1)], "a long, b long")
    zero = (F.lit(0).cast("long"), F.lit(0).cast("long"))
    got = [r[0] for r in frame.select(fp.likeness((F.col("a"), F.col("b")), zero)).collect()]
    assert got == [1.0, 0.0, pytest.approx(0.0, abs=1e-12)]


def test_registered_query_lists_near_classes(spark):
    from kinmat.llm.queries import QUERIES

    rows = QUERIES["op5_simhash_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    prints = [int(r["fingerprint"], 16) for r in rows]
    for r in rows:
        if r["doc_id"] % 50:
            assert r["n_near"] is None and r["near_fingerprints"] is None
            continue
        own = int(r["fingerprint"], 16)
        near = [p for p in prints if (p ^ own).bit_count() <= fp.SEARCH_RADIUS]
        assert r["n_near"] == len(near)
        assert r["near_fingerprints"] == ",".join(sorted({f"{p:032x}" for p in near if p != own}))
