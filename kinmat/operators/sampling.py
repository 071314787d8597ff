"""Samples and selections (SM-1..SM-5, TK-12, SO-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmat.constants import DEFAULT_SEED


def sample_key(idx: Column, seed: int) -> Column:
    """Seeded pseudo-random order of the ids, the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), idx.cast("string")))


def _ordered(store: DataFrame, seed: int) -> DataFrame:
    return store.withColumn("sample_key", sample_key(F.col("idx"), seed))


def _require(found: int, wanted: int) -> None:
    if found < wanted:
        raise ValueError(f"asked for {wanted} vectors, the store has {found}")


def sample_rows(store: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """SM-2: ``n`` distinct rows; a top-n, so nothing is fully sorted."""
    _require(store.select("idx").limit(n).count(), n)
    return _ordered(store, seed).orderBy("sample_key", "idx").limit(n).drop("sample_key")


def sample_disjoint(
    store: DataFrame, n_rows: int, n_cols: int, seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """SM-1: disjoint row and column samples from one seeded order."""
    n = n_rows + n_cols
    _require(store.select("idx").limit(n).count(), n)
    chosen = _ordered(store, seed).orderBy("sample_key", "idx").limit(n)
    # At most n rows are left for this window.
    position = F.row_number().over(Window.orderBy("sample_key", "idx"))
    placed = chosen.withColumn("position", position).drop("sample_key")
    rows = placed.where(F.col("position") <= n_rows).drop("position")
    cols = placed.where(F.col("position") > n_rows).drop("position")
    return rows, cols


def sample_extreme(store: DataFrame, n: int) -> DataFrame:
    """SM-3: the ``n`` smallest and the ``n`` largest norms, ties by index."""
    _require(store.select("idx").limit(2 * n).count(), 2 * n)
    smallest = store.orderBy("norm", "idx").limit(n)
    largest = store.orderBy(F.desc("norm"), F.desc("idx")).limit(n)
    return smallest.unionByName(largest)


def resolve_targets(store: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SM-4: (known targets as (idx, acc), unknown acc).

    A name that stands several times in the store means its last index.
    """
    named = store.select("acc", "idx").join(wanted.select("acc").distinct(), "acc", "left_semi")
    known = named.groupBy("acc").agg(F.max("idx").alias("idx")).select("idx", "acc")
    unknown = wanted.select("acc").distinct().join(known.select("acc"), "acc", "left_anti")
    return known, unknown


def require_targets(known: DataFrame) -> DataFrame:
    """No valid target at all is an error."""
    if known.isEmpty():
        raise ValueError("none of the targets is in the store")
    return known


def first_per_category(report: DataFrame, n: int) -> DataFrame:
    """SM-5: the first ``n`` of every category in store order."""
    order = Window.partitionBy("category").orderBy("idx")
    return report.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")
