"""Splitting hot join keys over several tasks without losing a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmat.constants import HOT_GROUP_ROWS, MAX_HOT_KEYS, MAX_LIST_ROWS
from kinmat.session import settle


def own_salt(column: str, salts: Column) -> Column:
    """The salt of one row of the large side, fixed by its own id."""
    return F.pmod(F.xxhash64(column), salts).cast("int")


def every_salt(salts: Column) -> Column:
    """All salts of a key: repeats a row of the other side once per salt."""
    return F.explode(F.sequence(F.lit(0), (salts - 1).cast("int")))


def salts_for(rows: Column, per_task: int = HOT_GROUP_ROWS) -> Column:
    """Salts of a key with a known number of rows; one for ordinary keys."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(per_task)).cast("int"))


def join_grouped(
    large: DataFrame,
    groups: DataFrame,
    key: str,
    rows: str,
    spread_by: str,
    how: str = "inner",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Join ``large`` to ``groups``, one row per ``key`` with its row count in ``large``.

    Keys above a share of 1/MAX_HOT_KEYS of all counted rows (and above
    ``hot_rows``) are hot; by that share there are fewer than MAX_HOT_KEYS of
    them, which bounds what is broadcast. Rows of a hot key are split by
    a hash of ``spread_by`` and its group row is repeated per piece. ``groups`` is
    read three times and should be a settled or cheap table.
    """
    total = groups.agg(F.sum(rows).alias("n")).first()["n"] or 0
    limit = max(hot_rows, total // MAX_HOT_KEYS)
    hot = groups.where(F.col(rows) > limit).select(key, salts_for(F.col(rows), limit).alias("salts"))
    if total <= limit or hot.isEmpty():
        return large.join(groups, key, how)
    split = (
        large.join(F.broadcast(hot), key, "left")
        .withColumn("salt", own_salt(spread_by, F.coalesce("salts", F.lit(1))))
        .drop("salts")
    )
    pieces = groups.withColumn("salt", every_salt(salts_for(F.col(rows), limit)))
    return split.join(pieces, [key, "salt"], how).drop("salt")


def first_in_group(
    df: DataFrame,
    key: str,
    order: list[Column],
    limit: int,
    rank: str,
    spread_by: str,
    max_rows: int = MAX_LIST_ROWS,
    level: Column | None = None,
) -> DataFrame:
    """The first ``limit`` rows of every ``key``, numbered in ``rank``.

    ``level`` is a whole number of few values that never rises along ``order``. Rows are counted by key and level, map-side
    first, and each group is cut at the level in which its rank ``limit`` lies: what is above is taken, what is below never
    sorted, and only of the cut level itself the first ones are looked for, in pieces of about ``max_rows`` by a hash of
    ``spread_by``. So no task ranks more than a piece, and a last time the first ``limit`` of each piece. The cuts are
    settled, a row per long group, so that Spark knows their size and need not shuffle ``df`` for them. ``df`` is read
    three times and should be a settled or cheap table.
    """
    rows = df.withColumn("__level__", F.lit(0) if level is None else level)
    down = Window.partitionBy(key).orderBy(F.desc("__level__")).rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(key, "__level__").agg(F.count(F.lit(1)).alias("__n__")).withColumn("__up_to__", F.sum("__n__").over(down))
    above = F.col("__up_to__") - F.col("__n__")
    cuts = settle(counts.where((above < limit) & (F.col("__up_to__") >= limit)).select(
        key, F.col("__level__").alias("__cut__"), (F.lit(limit) - above).alias("__need__"), salts_for(F.col("__n__"), max_rows).alias("__pieces__")
    ))
    marked = rows.join(cuts, key, "left")
    part = Window.partitionBy(key, "__piece__").orderBy(*order)
    at_cut = (
        marked.where("__level__ = __cut__")
        .withColumn("__piece__", own_salt(spread_by, F.col("__pieces__")))
        .withColumn(rank, F.row_number().over(part))
        .where(F.col(rank) <= F.col("__need__"))
    )
    taken = marked.where("__cut__ IS NULL OR __level__ > __cut__").select(*df.columns).unionByName(at_cut.select(*df.columns))
    whole = Window.partitionBy(key).orderBy(*order)
    return taken.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= limit)
