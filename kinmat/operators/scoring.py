"""A bounded block of query vectors against a whole store (J-1, J-2, J-3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmat.constants import ABSENT, MAX_BROADCAST_BYTES
from kinmat.model import PAIR_TRUTH_SCHEMA, ROW_TRUTH_SCHEMA, VectorStore
from kinmat.operators import kernel
from kinmat.operators.allpairs import block_pairs
from kinmat.session import ship_package, spread

_INPUT = ("idx", "acc", "norm_sq", "v")
# From so many queries on, comparing a vector of the store costs far more than moving it.
_MANY_QUERIES = 256
# Pairs that a task compares then, as many as a tile of the blocked join.
_TASK_PAIRS = 1 << 28


def _query_block(queries: DataFrame, dim: int, max_bytes: int) -> pa.Table | None:
    """The query vectors, or None when they and their ids exceed the bound."""
    limit = max(1, max_bytes // (4 * dim))
    size = queries.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("acc")).alias("names")).first()
    if size["n"] > limit or (size["names"] or 0) > max_bytes:
        return None
    return queries.select(*_INPUT).toArrow().sort_by("idx")


def _whole(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _dealt(store: VectorStore, n_queries: int) -> DataFrame:
    """The store for so many queries: in its splits while they are few, else dealt in equal parts of bounded work.

    Splits tell nothing about rows: a file of one row group is read by one task, whatever it is split into.
    """
    vectors = store.vectors.select(*_INPUT)
    if n_queries < _MANY_QUERIES:
        return spread(vectors, "idx")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    waves = max(1, math.ceil(store.vectors.count() * n_queries / (_TASK_PAIRS * cores)))
    # Neighbours in order of idx are shuffled and stored in less space later.
    return vectors.repartition(waves * cores, "idx").sortWithinPartitions("idx")


def full_rows(
    queries: DataFrame, store: VectorStore, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """All existing neighbours of every query row, self excluded (J-3, PF-2).

    While the query block stays within ``max_broadcast_bytes``, the store is scanned once. It is shuffled, once, only if it is
    read as fewer splits than there are cores, or for so many queries that comparing is what costs. More queries than
    the bound go through the blocked join of :func:`block_pairs`, which gives the same rows.
    """
    dim = store.dim
    block = _query_block(queries, dim, max_broadcast_bytes)
    if block is None:
        return block_pairs(queries, store)
    spark = queries.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        q_idx = _whole(table, "idx").to_numpy()
        q_acc = _whole(table, "acc")
        q_sq = _whole(table, "norm_sq").to_numpy()
        q_vec = kernel.vectors_of(_whole(table, "v"), dim)
        for batch in batches:
            c_idx = batch.column("idx").to_numpy()
            c_sq = batch.column("norm_sq").to_numpy()
            c_vec = kernel.vectors_of(batch.column("v"), dim)
            for i, j, jaccard in kernel.existing_cells(q_vec, q_sq, c_vec, c_sq, dim):
                other = q_idx[i] != c_idx[j]
                i, j, jaccard = i[other], j[other], jaccard[other]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q_idx[i]),
                        q_acc.take(pa.array(i)),
                        pa.array(c_idx[j]),
                        batch.column("acc").take(pa.array(j)),
                        pa.array(jaccard),
                        pa.array(kernel.quantise(jaccard)),
                    ],
                    names=ROW_TRUTH_SCHEMA.names,
                )

    return _dealt(store, block.num_rows).mapInArrow(score, ROW_TRUTH_SCHEMA)


def _pair_cells(rows: pa.Table, cols: pa.Table | pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """Every cell between two blocks, equal ids skipped."""
    column = lambda table, name: (
        _whole(table, name) if isinstance(table, pa.Table) else table.column(name)
    )
    q_idx, q_acc, q_sq = column(rows, "idx").to_numpy(), column(rows, "acc"), column(rows, "norm_sq").to_numpy()
    c_idx, c_acc, c_sq = column(cols, "idx").to_numpy(), column(cols, "acc"), column(cols, "norm_sq").to_numpy()
    q_vec, c_vec = (kernel.vectors_of(column(side, "v"), dim) for side in (rows, cols))
    for i, j, exists, jaccard in kernel.every_cell(q_vec, q_sq, c_vec, c_sq, dim):
        other = q_idx[i] != c_idx[j]
        i, j, exists, jaccard = i[other], j[other], exists[other], jaccard[other]
        q = np.zeros(len(i), dtype=np.int32)
        q[exists] = kernel.quantise(jaccard[exists])
        absent = ~exists
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(q_idx[i]),
                pa.array(c_idx[j]),
                q_acc.take(pa.array(i)),
                c_acc.take(pa.array(j)),
                pa.array(exists.astype(np.int32)),
                pa.array(jaccard, mask=absent),
                pa.array(q, mask=absent),
            ],
            names=PAIR_TRUTH_SCHEMA.names,
        )


def _tiled_pair_truth(rows: DataFrame, cols: DataFrame, dim: int, max_bytes: int) -> DataFrame:
    """Row blocks against column blocks, each within the bound; rows of the result leave tile by tile."""
    limit = max(1, max_bytes // (4 * dim))
    sides = []
    for side, (frame, other) in enumerate(((rows, cols), (cols, rows))):
        own, facing = (max(1, -(-f.count() // limit)) for f in (frame, other))
        block = F.pmod(F.xxhash64("idx"), F.lit(own)).cast("int")
        partner = F.explode(F.sequence(F.lit(0), F.lit(facing - 1)))
        names = ("tile_row", "tile_col") if side == 0 else ("tile_col", "tile_row")
        sides.append(
            frame.select(*_INPUT, F.lit(side).alias("side"), block.alias(names[0]), partner.alias(names[1]))
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows])
        side = table.column("side").to_numpy()
        left, right = (table.take(pa.array(np.flatnonzero(side == s))) for s in (0, 1))
        if left.num_rows and right.num_rows:
            yield from _pair_cells(left, right, dim)

    tiled = sides[0].unionByName(sides[1])
    return tiled.groupBy("tile_row", "tile_col").applyInArrow(score, PAIR_TRUTH_SCHEMA)


def pair_truth(
    rows: DataFrame, cols: DataFrame, dim: int, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Every (row, col) pair with its verdict, equal ids skipped (J-1, J-2, D5).

    Absent pairs are part of the result, so both sides are usually samples. A row side
    within ``max_broadcast_bytes`` is broadcast; a larger one meets the columns in tiles,
    with the same rows as result.
    """
    ship_package(rows.sparkSession)
    block = _query_block(rows, dim, max_broadcast_bytes)
    if block is None:
        return _tiled_pair_truth(rows, cols, dim, max_broadcast_bytes)
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pair_cells(shared.value, batch, dim)

    return cols.select(*_INPUT).mapInArrow(score, PAIR_TRUTH_SCHEMA)


def with_sentinels(truth: DataFrame) -> DataFrame:
    """-1 instead of NULL in the value columns of absent pairs (SNK-1)."""
    return truth.withColumns({
        "jaccard_raw": F.coalesce("jaccard_raw", F.lit(float(ABSENT))),
        "jaccard_quantized": F.coalesce("jaccard_quantized", F.lit(ABSENT)),
    })
