"""An exact histogram of encoded lengths that answers every context limit."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmat.llm.byte_bpe import parts
from kinmat.llm.frames import map_texts
from kinmat.llm.tokens import rank_encoding
from kinmat.session import settle

#: Lengths summed together before the running sums, so that no task sees all of them.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, ranks: str, pattern: str, column: str = "text") -> DataFrame:
    """One row n_tokens for each document, of its whole text; a null text counts as empty and has none."""

    def make():
        encoding = rank_encoding(ranks, pattern)

        def work(texts: list[str]) -> dict[str, Iterable]:
            return {"n_tokens": [sum(len(encoding.encode_ordinary(p)) for p in parts(t)) for t in texts]}

        return work

    return map_texts(docs, column, make, pa.schema([("n_tokens", pa.int64())]), keep=[])


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per encoded length: n_docs, and by suffix sums what a context limit of that length means.

    n_longer and tokens_longer are of the documents above the limit; truncated_total is
    the number of tokens left when every document is cut at the limit, lost_total the number cut away;
    n_up_to is the number of documents that fit, which gives quantiles.
    Rows with a null length are left out; an empty table gives an empty histogram. A block of lengths is
    summed first, so running sums pass over blocks and then within one. Lengths are counted once and settled, as
    encoding is what costs.
    """
    counts = settle(
        lengths.where(F.col("n_tokens").isNotNull())
        .groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    )
    blocks = counts.groupBy("block").agg(
        F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("block_tokens")
    )
    ordered = Window.orderBy("block")
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)

    def total(column: str, over) -> Column:
        return F.coalesce(F.sum(column).over(over), F.lit(0))

    # One row per block of lengths: as many as the longest document has blocks, whatever the number of documents.
    around = blocks.select(
        "block",
        total("block_docs", later).alias("docs_after"),
        total("block_tokens", later).alias("tokens_after"),
        total("block_docs", earlier).alias("docs_before"),
        total("block_tokens", earlier).alias("tokens_before"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens")
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")).join(around, "block").select(
        "n_tokens",
        "n_docs",
        (total("n_docs", after) + F.col("docs_after")).alias("n_longer"),
        (total("tokens", after) + F.col("tokens_after")).alias("tokens_longer"),
        (total("n_docs", up_to) + F.col("docs_before")).alias("n_up_to"),
        (total("tokens", up_to) + F.col("tokens_before")).alias("tokens_up_to"),
    )
    limit = F.col("n_tokens") * F.col("n_longer")
    return summed.select(
        "n_tokens",
        "n_docs",
        "n_up_to",
        "n_longer",
        "tokens_up_to",
        "tokens_longer",
        (F.col("tokens_up_to") + limit).alias("truncated_total"),
        (F.col("tokens_longer") - limit).alias("lost_total"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length up to which at least each share of all documents fits: share, n_tokens."""
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    whole = F.col("n_up_to") + F.col("n_longer")
    return (
        histogram.select("*", share)
        .where(F.col("n_up_to") >= F.col("share") * whole)
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total, n_longer for any context limits, whether or not a document has that length."""
    limit = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    n, x = F.col("n_tokens"), F.col("limit")
    return (
        histogram.select("n_tokens", "n_docs", limit)
        .groupBy("limit")
        .agg(
            F.sum(F.least(n, x) * F.col("n_docs")).alias("truncated_total"),
            F.coalesce(F.sum(F.when(n > x, F.col("n_docs"))), F.lit(0)).alias("n_longer"),
        )
    )
