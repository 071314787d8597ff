"""From raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmat.llm import fertility, packing, pii, simhash_dedup, toxicity
from kinmat.llm.frames import apart
from kinmat.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tokens of a packed sequence.
CAPACITY = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of tokenizer fertility; columns as they were."""
    plain, named = apart(docs, ("doc_id", "text", "lang"))
    # What is measured is kept without the texts; equal rows have equal keys and one verdict.
    row = ["doc_id", "lang", "text", F.isnull("lang"), F.isnull("text")]
    keyed = plain.withColumns({"key_1": F.xxhash64(*row), "key_2": F.xxhash64(F.lit("second"), *row)})
    vocabulary = vocabularies.path("piece_bpe_32k.model")
    measured = settle(fertility.measure(keyed, vocabulary, keep=["lang", "key_1", "key_2"]))
    kept = fertility.judge(measured).where("kept").select("key_1", "key_2").distinct()
    return named(keyed.join(kept, ["key_1", "key_2"], "left_semi"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not find toxic; columns as they were."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.fit(docs, labels, toxicity.remainder() != 2)
    plain, named = apart(docs, ("doc_id", "text"))
    return named(toxicity.score(plain, grammar).where("predicted = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; columns as they were."""
    return simhash_dedup.drop_near_copies(docs)


def sanitise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose them masked in text; other columns as they were."""
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence and their ids (little-endian, 32 bits each)."""
    return packing.pack_documents(docs, vocabularies.path("word_bpe_49k.json"), CAPACITY, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-dedup", near_dedup),
    ("pii", sanitise_pii),
    ("packing", best_fit_packing),
]

#: Tokenizers, fitted bands and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
