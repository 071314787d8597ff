"""Connected components as joins and minima; no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmat.session import settle


def _to_neighbours_least(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()


def _to_own_least(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link to another one; label is the least node reachable.

    Alternates the two star steps until nothing changes, so the number of rounds grows with the
    logarithm of the longest path. Every round is settled in the shared folder. Null ends, loops and
    repeated links are ignored; no links give no rows. A node with very many links is one
    key of joins that Spark splits, and of minima that are combined before they are shuffled.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    edges = settle(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = settle(_to_own_least(_to_neighbours_least(edges)))
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("sum")).first()
        if (row["n"], row["sum"]) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        state = (row["n"], row["sum"])
