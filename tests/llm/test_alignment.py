import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinmat.llm import alignment
from kinmat.llm.queries import QUERIES
from kinmat.llm.tokens import byte_symbols

A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

TEXTS = [
    None, "", " ", "a  b", "\n x \n", "tab\there", "▁x ▁", "<s> <0x41> </s> <unk> <|endoftext|> x", "漢字 かな 🙂 x", "a" * 5000,
    "x\x00y z", "don't we'll  I'm", "\x1c a\x85b", "é é ﬁ", " lead", "trail ", "same same same", "same same same", "word " * 20000,
]


def brute(texts):
    """Whole texts through both libraries; ends compared one by one."""
    tokenizer, processor = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    shown = {number: token for token, number in tokenizer.get_vocab().items()}
    value = {s: i for i, s in enumerate(byte_symbols())}
    links, rows, counts = [], [], Counter()
    for text in texts:
        a = tokenizer.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = processor.encode(text) if text else []
        bytes_a = [bytes(value[s] for s in shown[i]) for i in a]
        bytes_b = [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends = dict(zip(np.cumsum([len(x) for x in bytes_a], dtype=int).tolist(), range(len(a))))
        own, groups, from_a, from_b = [], [], 0, 0
        for j, end in enumerate(np.cumsum([len(x) for x in bytes_b], dtype=int).tolist()):
            if end in ends:
                i = ends[end]
                own.append((a[i], b[j]))
                groups.append(",".join(map(str, a[from_a : i + 1])) + "|" + ",".join(map(str, b[from_b : j + 1])))
                from_a, from_b = i + 1, j + 1
        links.append(own)
        counts.update(own)
        rows.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*r[:4], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return TEXTS + ["".join(rng.choice("abcdeE éßÜ.,'!?\n\t12  \x1c漢🙂") for _ in range(rng.randrange(1, 300))) for _ in range(150)]


@pytest.mark.parametrize("wave_bytes", [1 << 26, 4000])
def test_against_brute_force(spark, texts, wave_bytes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alignment.correspondences(docs, A, B, wave_bytes=wave_bytes).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == texts
    assert [tuple(r[f] for f in FIELDS) for r in found] == brute(texts)


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 1000])
def test_merge_path(steps):
    rng = np.random.default_rng(steps)
    for size_a, size_b, most in [(0, 0, 1), (0, 5, 9), (5, 0, 9), (1, 1, 1), (40, 30, 60), (30, 400, 500), (200, 200, 200)]:
        a, b = (np.sort(rng.choice(most, min(n, most), replace=False)) for n in (size_a, size_b))
        at_a, at_b = alignment.shared_ends(a, b, steps)
        assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()
        i, j = alignment.diagonal_starts(a, b, steps)
        assert (i + j == np.arange(0, len(a) + len(b), steps)).all()


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "x"), (1, "one two", 5, "x")], "doc_id long, text string, N_A int, pairs string")
    rows = alignment.correspondences(docs, A, B).collect()
    assert [(r["doc_id"], r["n_a"], r["n_links"]) for r in rows] == [(1, 2, 2)] * 2
    assert alignment.correspondences(docs.limit(0), A, B).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op13_token_alignment"](spark, folder).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r[f] for f in FIELDS) for r in rows] == brute([d["text"] for d in docs])
