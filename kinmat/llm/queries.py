"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers as vocabularies

from kinmat.llm import (
    alignment,
    byte_bpe,
    fertility,
    filter_audit,
    fingerprints,
    language_model,
    licenses,
    packing,
    pii,
    simhash_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from kinmat.llm.frames import documents
from kinmat.session import settle


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and the smallest doc_id reachable over fingerprints at most 2 bits apart. A null text has fingerprint zero."""
    found = settle(simhash_dedup.fingerprints(documents(spark, sf_dir), shingle=3, keep=["doc_id"]))
    return simhash_dedup.near_components(found, radius=2, segments=3).select(
        "doc_id", simhash_dedup.hex_digits("fingerprint").alias("fingerprint"), "component_id"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens. A null text is one end token."""
    return packing.pack_documents(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"), 4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every whole text, and the digest of what they decode to. A null text has none."""
    encoded = byte_bpe.encode(
        documents(spark, sf_dir),
        vocabularies.path("byte_bpe_multi_50k.tiktoken"),
        vocabularies.PATTERN,
        decoded=True,
        keep=["doc_id"],
    )
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and lines whose canonical form is that of a known licence; a null text has none."""
    return licenses.scan(documents(spark, sf_dir), licenses.known_licenses(spark))


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and the near classes of the query set's. A null text is empty."""
    found = fingerprints.with_next(fingerprints.edited_fingerprints(documents(spark, sf_dir)))
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    near = fingerprints.near_documents(found, asked, fingerprints.SEARCH_RADIUS)
    own, edited, following = [(F.col(f"{n}_high"), F.col(f"{n}_low")) for n in ("fp", "edited", "next")]
    return found.join(near, ["fp_high", "fp_low"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.hex_digits("fp_high", "fp_low").alias("fingerprint"),
        fingerprints.hex_digits("edited_high", "edited_low").alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"),
        fingerprints.likeness(own, following).alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
        F.when(asked, F.array_join("near_prints", ",")).alias("near_fingerprints"),
    )


def op6_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and verdict of every text. A null text has no words and fails the base rules."""
    measured = fertility.measure(
        documents(spark, sf_dir), vocabularies.path("piece_bpe_32k.model"), keep=["doc_id", "lang"]
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    measures = ["n_tokens", "chars_per_token", "byte_share", "entropy", "script"]
    return fertility.judge(settle(measured)).select("doc_id", *counts, *measures)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every encoded length, how many documents have it and what it means as a context limit. A null text has length 0."""
    lengths = token_counts.encoded_lengths(
        documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    )
    return token_counts.length_histogram(lengths)


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by a grammar learnt from the rows that are not held out. A null text is empty and is scored, too."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.fit(docs, labels, toxicity.remainder() != 2)
    held_out = F.coalesce(toxicity.remainder() == 2, F.lit(False))
    return toxicity.score(docs, grammar, keep=["doc_id"], threshold=0.3).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A null url has neither host nor path and is allowed."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rules_table(spark))


def op10_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the four kinds by pattern, their digest, and all spans of every text. A null text has none."""
    found = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.PATTERNS],
        F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op11_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text by the quantised n-gram counts of the texts that are not held out."""
    docs, fifth = documents(spark, sf_dir), language_model.remainder()
    model = language_model.fit(docs, language_model.in_training(fifth))
    held_out = F.coalesce(fifth == 1, F.lit(False))
    return language_model.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of every order, by source."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers with common ends, and how usual each text's linked tokens are."""
    return alignment.correspondences(
        documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model"), keep=["doc_id"]
    ).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_best_fit_packing,
        op3_byte_bpe,
        op4_license_scan,
        op5_simhash_fingerprints,
        op6_tokenizer_fertility,
        op7_token_counts,
        op8_toxicity_grammar,
        op9_url_filter,
        op10_information_pii,
        op11_bloom_language_model,
        op12_filter_audit,
        op13_token_alignment,
    )
}

ORACLE: dict[str, str] = {
    "op4_license_scan": licenses.scan_sql(),
    "op9_url_filter": url_filter.judge_sql(),
    "op12_filter_audit": filter_audit.audit_sql(),
}
