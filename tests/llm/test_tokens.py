import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinmat.llm import byte_bpe, packing, token_counts
from kinmat.llm.tokens import WordMemory, rank_encoding, word_encoder

WORDS = vocabularies.path("word_bpe_49k.json")
RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")

TEXTS = [
    "",
    " ",
    "\n\t\x0b\x0c\r",
    "Plain words, and more. It's the dog's; don't!!! 42 times 1234",
    "Ünïcödé straße ÉCOLE, naïve… Ελληνικά ΣΊΣΥΦΟΣ кириллица 漢字かな 한국어",
    "é combining, Å and   odd space \x1c\x1d\x85 end",
    "<|endoftext|> is text here <|startoftext|>",
    "a" * 3000 + " " + "b1" * 500,
    "  leading and trailing  \n\n\n",
    "emoji 🙂🙂 mixed🙂with words",
]


def random_text(rng, length):
    return "".join(rng.choice("abcdeE éßÜ.,'!?\n\t1234  \x1c漢🙂") for _ in range(length))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return TEXTS + [random_text(rng, rng.randrange(1, 400)) for _ in range(200)]


def test_word_encoder_is_the_library(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    encode = word_encoder(WORDS)
    for text in texts * 2:
        expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert encode(text) == expected.tobytes(), text[:80]


def test_word_memory_stays_small_and_right():
    memory = WordMemory(str.upper, size=10)
    for i in range(300):
        assert memory[f"w{i % 37}"] == f"W{i % 37}"
    assert len(memory) <= 10
    assert memory["x" * 100] == "X" * 100 and "x" * 100 not in memory


def test_parts_encode_to_the_whole(texts):
    encoding = rank_encoding(RANKS, vocabularies.PATTERN)
    for text in texts:
        cut = byte_bpe.parts(text, 16)
        assert "".join(cut) == text
        ids = [i for p in cut for i in encoding.encode_ordinary(p)]
        assert ids == encoding.encode_ordinary(text)


def test_encode_and_decode(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.encode(docs, RANKS, vocabularies.PATTERN, decoded=True)
    back = byte_bpe.decode(out.drop("decoded"), RANKS, vocabularies.PATTERN)
    found = back.collect()
    assert len(found) == len(rows)
    reference = tiktoken.Encoding("r", pat_str=vocabularies.PATTERN, mergeable_ranks=rank_encoding(RANKS, vocabularies.PATTERN)._mergeable_ranks, special_tokens={})
    for r in found:
        text = r["text"] or ""
        ids = np.array(reference.encode_ordinary(text), dtype="<u4")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == ids.tobytes()
        assert bytes(r["decoded"]) == text.encode()
    assert out.limit(0).count() == 0


def test_raw_bytes_are_decoded(spark):
    encoding = rank_encoding(RANKS, vocabularies.PATTERN)
    half = np.array(encoding.encode_ordinary("漢")[:1], dtype="<u4").tobytes()
    frame = spark.createDataFrame([(half,), (b"",), (None,)], "ids binary")
    found = [r["decoded"] for r in byte_bpe.decode(frame, RANKS, vocabularies.PATTERN).collect()]
    assert [None if x is None else bytes(x) for x in found] == [encoding.decode_bytes([np.frombuffer(half, "<u4")[0]]), b"", None]


def check_placed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_documents(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (7, TEXTS[7]), (7, TEXTS[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(3)).withColumn("part", F.lit(1))
    capacity = 64
    out = packing.pack_documents(docs, WORDS, capacity, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    expected = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            data = np.array(ids[start : start + capacity], dtype="<u4").tobytes()
            expected.append((doc if doc is not None else -1, piece, start, len(data) // 4, zlib.crc32(data), data))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out]
    assert sorted(got) == sorted(expected)
    total = sum(e[3] for e in expected)
    assert -(-total // capacity) <= check_placed(out, capacity) <= -(-total // capacity) + 1
    assert packing.pack_documents(docs.limit(0), WORDS, capacity).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_no_worse_than_greedy(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1000])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(400)]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.best_plan(histogram, capacity)
    used = {}
    for bin_, times in plan:
        assert sum(length * n for length, n in bin_.items()) <= capacity and times > 0
        for length, n in bin_.items():
            used[length] = used.get(length, 0) + n * times
    assert used == histogram
    greedy = sum(t for _, t in packing.plan_bins(histogram, capacity, two_fit=False))
    assert sum(t for _, t in plan) <= greedy


def test_two_fit_beats_greedy():
    # Greedy gives 60+30, then 45+45 with a gap of ten, and so on; the pair 55+45 fits exactly.
    histogram = {60: 1, 30: 1, 21: 1, 19: 1}
    (bin_, _), *_ = packing.plan_bins(histogram, 100)
    assert bin_ == {60: 1, 21: 1, 19: 1}


def test_a_common_length_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED_TOGETHER", 10)
    pieces = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20 + 1).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    out = packing.pack(pieces, 32).collect()
    assert len(out) == 300 and len({r["doc_id"] for r in out}) == 300
    assert check_placed(out, 32) == -(-sum(r["length"] for r in out) // 32)


def test_length_histogram_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 2, 5, 9, 30, 31, 100]) for _ in range(200)]
    frame = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    rows = token_counts.length_histogram(frame).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["n_up_to"] == sum(x <= n for x in lengths) and r["n_longer"] == sum(x > n for x in lengths)
        assert r["tokens_up_to"] == sum(x for x in lengths if x <= n) and r["tokens_longer"] == sum(x for x in lengths if x > n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["lost_total"] == sum(max(0, x - n) for x in lengths)
    histogram = token_counts.length_histogram(frame)
    got = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(histogram, [0.1, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert got == {s: ordered[max(0, int(np.ceil(s * len(ordered))) - 1)] for s in (0.1, 0.5, 1.0)}
    at = {r["limit"]: (r["truncated_total"], r["n_longer"]) for r in token_counts.totals_at(histogram, [3, 50, 1000]).collect()}
    assert at == {x: (sum(min(n, x) for n in lengths), sum(n > x for n in lengths)) for x in (3, 50, 1000)}
    assert token_counts.length_histogram(frame.limit(0)).collect() == []


def test_encoded_lengths(spark):
    docs = spark.createDataFrame([(1, t) for t in TEXTS] + [(None, None)], "n_tokens long, text string")
    encoding = rank_encoding(RANKS, vocabularies.PATTERN)
    got = sorted(r["n_tokens"] for r in token_counts.encoded_lengths(docs, RANKS, vocabularies.PATTERN).collect())
    assert got == sorted(len(encoding.encode_ordinary(t or "")) for t in [*TEXTS, None])


def test_registered_digests(spark):
    from kinmat.llm.queries import QUERIES

    out = QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    encoding = rank_encoding(RANKS, vocabularies.PATTERN)
    expected = {}
    for r in docs:
        ids = np.array(encoding.encode_ordinary(r["text"] or ""), dtype="<u4")
        expected[r["doc_id"]] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()} == expected
