import collections
import math
import random
import re

import pytest
import sentencepiece
import public_tokenizers as vocabularies

from kinmat.llm import fertility, licenses

PIECES = vocabularies.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated),
        len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    )


TEXTS = [
    "", None, " \n\n\t", "one", "a b c a b c", "x " * 400, "same line\nsame line\n\nother\nsame line ",
    "ÄÖ é 漢字 🙂 \x1c \x85   odd", "a|b|c # $ % & < > *", "tie a tie a tie", "x" * 200_000,
]


def test_base_counts_and_measures(spark):
    docs = spark.createDataFrame([(i, t, "en", 9) for i, t in enumerate(TEXTS)] + [(None, "a b", None, None)], "doc_id long, text string, lang string, kept long")
    rows = fertility.measure(docs, PIECES).collect()
    assert len(rows) == len(TEXTS) + 1
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in rows:
        text = r["text"] or ""
        assert tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_base(text)
        ids = [i for w in WORD.findall(text) for i in processor.encode(w)]
        counts = collections.Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
        assert r["n_tokens"] == len(ids) and r["n_byte_tokens"] == sum(processor.is_byte(i) for i in ids)
        assert r["entropy"] == pytest.approx(entropy, abs=1e-9)


def test_scripts():
    assert [fertility.script_of(t) for t in ("", "12 !", "abc é", "кириллица a", "漢字かな漢", "Ελληνικά")] == [
        "Common", "Common", "Latin", "Cyrillic", "Han", "Greek"
    ]


def test_bands_reject_what_differs_from_its_language(spark):
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(200)), "en") for i in range(150)]
    junk = [(1000 + i, " ".join(rng.choice(vocabulary) + "###$$$"[i % 4 :] for _ in range(200)), "en") for i in range(5)]
    short = [(2000, "too short", "en"), (2001, None, None), (2002, "", "en")]
    docs = spark.createDataFrame(rows + junk + short, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in fertility.judge(fertility.measure(docs, PIECES)).collect()}
    assert len(got) == len(rows + junk + short)
    assert sum(got[i] for i, *_ in rows) >= 148
    assert not any(got[i] for i, *_ in junk + short)
    assert fertility.judge(fertility.measure(docs.limit(0), PIECES)).collect() == []


def test_bands_are_exact_quartiles(spark):
    columns = "lang string, script string, n_words long, entropy double, chars_per_token double, byte_share double, base_failed boolean"
    values = [5.0, 5.1, 5.2, 5.3, 6.0, 7.0, 9.0]
    rows = [("en", "Latin", 100, v, 2.0, 0.0, False) for v in values] + [("en", "Latin", 100, 50.0, 2.0, 0.0, True)]
    rows += [(None, "Greek", 100, 1.0, 2.0, 0.0, False)]
    bands = {r["band_group"]: r for r in fertility.fit_bands(spark.createDataFrame(rows, columns)).collect()}
    spread = (7.0 - 5.1) / 1.349
    assert bands["en"]["entropy_low"] == pytest.approx(5.3 - 3 * spread, abs=0.01)
    assert bands["en"]["entropy_high"] == pytest.approx(5.3 + 8 * spread, abs=0.01)
    assert bands["Greek"]["entropy_low"] == pytest.approx(1.0 - 3 * 0.03)


def test_licenses(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and "granted" in t)
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", "  ,")),
        (2, "words\n  Released under the MIT LICENCE!  \nReleased under the MIT License\nCopyright 2020"),
        (3, "it says Released under the MIT License here"),
        (4, None), (5, ""), (6, "(c) only me"), (None, "Licensed under CC BY-NC 4.0."), (7, "licensed under cc by nc 4 0"),
        (8, "x " * 100_000 + "\nLicensed under the Apache Licence, version 2.0"), (7, "Licensed under CC-BY-NC 4.0"),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    known = licenses.known_licenses(spark, licenses.KNOWN + [("odd", "Copyright nobody")])
    got = {(r["doc_id"], r["unit"], r["license"]): r["n_found"] for r in licenses.scan(docs, known).collect()}
    assert got == {
        (1, "text", "MIT"): 1, (2, "line", "MIT"): 2, (None, "text", "CC-BY-NC-4.0"): 1, (None, "line", "CC-BY-NC-4.0"): 1,
        (7, "text", "CC-BY-NC-4.0"): 2, (7, "line", "CC-BY-NC-4.0"): 2, (8, "line", "Apache-2.0"): 1,
        (1, "line", "MIT"): 1,
    }
    assert licenses.scan(docs.limit(0), known).collect() == []


def test_copies_do_not_narrow_the_bands(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choice(vocabulary[: rng.randrange(60, 2000)]) for _ in range(200)) for _ in range(120)]
    entropy = {r["doc_id"]: r["entropy"] for r in fertility.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()}
    upper = sorted(entropy, key=entropy.get)[90]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, texts[upper], "en") for i in range(300)]

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return {r["doc_id"] for r in fertility.judge(fertility.measure(docs, PIECES)).collect() if r["kept"] and r["doc_id"] < 1000}

    assert kept(rows) == kept(rows[:120])
    junk = " ".join(rng.choice(vocabulary) + "###$$$" for _ in range(200))
    assert fertility.judge(fertility.measure(spark.createDataFrame(rows[:120] + [(5000 + i, junk, "en") for i in range(300)], "doc_id long, text string, lang string"), PIECES)).where("doc_id >= 5000 and kept").count() == 0


def test_a_cell_of_few_texts_takes_in_its_neighbours(spark):
    columns = "lang string, script string, n_words long, entropy double, chars_per_token double, byte_share double, base_failed boolean, copy_group long"
    rows = [("en", "Latin", 100, 5.0 + i / 20, 2.0, 0.0, False, i) for i in range(40)]
    rows += [("en", "Latin", 400, 6.0, 2.0, 0.0, False, 99)] * 500
    bands = {r["band_length"]: r for r in fertility.fit_bands(spark.createDataFrame(rows, columns)).collect()}
    assert bands[17]["entropy_low"] < 5.0 and bands[17]["entropy_high"] > 9.0 and bands[13]["entropy_low"] < 4.0
