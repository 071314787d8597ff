"""Blocked thresholded self-join of a vector store (J-4).

The pairs of n dense vectors are the cells of a square. It is cut into
tiles of two bounded slabs; every vector goes to the tiles of its slab. A task
holds one slab of a tile while the other one streams past it. Vectors whose norms are too far apart
for a pair to exist never share a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmat.constants import EXIST_FRACTION, MAX_TILE_BYTES
from kinmat.model import ROW_TRUTH_SCHEMA, VectorStore
from kinmat.operators import kernel
from kinmat.operators.skew import join_grouped
from kinmat.session import settle, ship_package

# A pair needs n_i * n_j > 0.05 * (n_i^2 + n_j^2) by Cauchy-Schwarz, so the
# larger norm is below 19.95 times the smaller one. The band is a little wider.
_RATIO = 1.0025 * (1 + math.sqrt(1 - 4 * EXIST_FRACTION**2)) / (2 * EXIST_FRACTION)
_MAX_TASKS = 20_000
_MIN_BLOCK_ROWS = 1024
# Rows of a slab while the tiles stay few: a task then compares 268 million pairs at most.
_SLAB_ROWS = 16_384

_SUMS = "row_idx long, n_cells long, q_sum long, self_q short, row_copies long"

_TILE_SCHEMA = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("col_idx", T.LongType()),
    T.StructField("jaccard_raw", T.DoubleType()),
    T.StructField("q", T.ShortType()),
    T.StructField("row_copies", T.LongType()),
    T.StructField("col_copies", T.LongType()),
])


def _band(store: VectorStore) -> Column:
    if not store.derived_norms:
        return F.lit(0)
    return F.floor(F.ln("norm_sq") / F.lit(2 * math.log(_RATIO))).cast("int")


def _banded(store: VectorStore) -> DataFrame:
    """A zero vector has no pair at all when its norm comes from itself."""
    vectors = store.vectors.where("norm_sq > 0") if store.derived_norms else store.vectors
    return vectors.withColumn("band", _band(store))


def block_rows_for(total: int, dim: int, parallelism: int, max_bytes: int = MAX_TILE_BYTES) -> int:
    """Largest block within the memory bound that still gives every core a tile and keeps a task short.

    The work of a tile grows with the square of its rows, so they are bounded as long as the tiles are not too many.
    """
    by_memory = max(1, max_bytes // (4 * dim))
    by_cores = max(_MIN_BLOCK_ROWS, math.ceil(total / max(1, math.isqrt(2 * parallelism))))
    by_time = max(_SLAB_ROWS, math.ceil(total / math.isqrt(2 * _MAX_TASKS)))
    return max(1, min(by_memory, by_cores, by_time))


def _block_plan(counts: dict[int, int], block_rows: int) -> list[tuple[int, int, int, int, int]]:
    """Per band: (band, first block, blocks, first partner, last partner)."""
    first, plan = 0, {}
    for band in sorted(counts):
        blocks = max(1, math.ceil(counts[band] / block_rows))
        plan[band] = (first, blocks)
        first += blocks
    rows = []
    for band, (start, blocks) in plan.items():
        low = plan.get(band - 1, (start, blocks))[0]
        last_start, last_blocks = plan.get(band + 1, (start, blocks))
        rows.append((band, start, blocks, low, last_start + last_blocks - 1))
    return rows


def _with_blocks(banded: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    # One row per norm band; doubles have fewer than 500 of them.
    bands = banded.sparkSession.createDataFrame(
        plan, "band int, start int, blocks int, low int, high int"
    )
    return banded.join(F.broadcast(bands), "band").withColumn(
        "block", (F.col("start") + F.pmod(F.xxhash64("idx"), F.col("blocks"))).cast("int")
    )


def _scored(left: kernel.Block, right: kernel.Block, diagonal: bool, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both blocks and values of the existing cells. Self cells occur once, on the diagonal.

    A self-join keeps each other pair once; queries against a store keep all but self.
    """
    for i, j, jaccard in kernel.existing_cells(left.vectors, left.norm_sq, right.vectors, right.norm_sq, dim):
        keep = left.idx[i] <= right.idx[j] if diagonal else left.idx[i] != right.idx[j]
        yield i[keep], j[keep], jaccard[keep]


class _Cells:
    """Every cell of a tile as a row."""

    schema = _TILE_SCHEMA

    def of(self, left: kernel.Block, right: kernel.Block, diagonal: bool, dim: int) -> Iterator[pa.RecordBatch]:
        for i, j, jaccard in _scored(left, right, diagonal, dim):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(left.idx[i]),
                    pa.array(right.idx[j]),
                    pa.array(jaccard),
                    pa.array(kernel.quantise(jaccard).astype(np.int16)),
                    pa.array(left.copies[i]),
                    pa.array(right.copies[j]),
                ],
                names=_TILE_SCHEMA.names,
            )


class _Sums:
    """Sums over the cells of each vector of a tile, both directions; no cell leaves the task."""

    schema = _SUMS

    def of(self, left: kernel.Block, right: kernel.Block, diagonal: bool, dim: int) -> Iterator[pa.RecordBatch]:
        sides = [(np.zeros((2, len(b.idx)), dtype=np.int64), b) for b in (left, right)]
        selves = np.full(len(left.idx), -1, dtype=np.int16)
        for i, j, jaccard in _scored(left, right, diagonal, dim):
            q, same = kernel.quantise(jaccard).astype(np.int64), left.idx[i] == right.idx[j]
            selves[i[same]] = q[same]
            # A self cell stands once in its row, any other one in the rows of both its ends.
            for (sums, _), at, far, once in ((sides[0], i, right.copies[j], slice(None)), (sides[1], j, left.copies[i], ~same)):
                at, far, value = at[once], far[once], q[once]
                order = np.argsort(at, kind="stable")
                at, far, value = at[order], far[order], value[order]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                if len(starts):
                    sums[0, at[starts]] += np.add.reduceat(far, starts)
                    sums[1, at[starts]] += np.add.reduceat(far * value, starts)
        for (sums, block), own in zip(sides, (selves, np.full(len(right.idx), -1, dtype=np.int16)), strict=True):
            found = np.flatnonzero(sums[0])
            columns = [block.idx[found], *sums[:, found]]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(own[found], mask=own[found] < 0), pa.array(block.copies[found])],
                names=["row_idx", "n_cells", "q_sum", "self_q", "row_copies"],
            )


def _join_tiles(tiled: DataFrame, dim: int, tiles: int, triangular: bool, result: type[_Cells] | type[_Sums] = _Cells) -> DataFrame:
    """Score each tile: side 0 against side 1, or a diagonal slab against itself.

    Of each tile side 0 comes first and is held; side 1 streams past it in Arrow batches, so a task needs the memory of
    one slab and slabs can be large. The number of copies of a vector that are shuffled falls with their size.
    """

    def score(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        held, left = [], None
        for batch in batches:
            side = batch.column("side")
            own, other = (batch.filter(pc.equal(side, s)) for s in (0, 1))
            if own.num_rows:
                if left is not None:
                    raise ValueError("the slab must come before what streams past it")
                held.append(kernel.Block.of(own, dim))
            if other.num_rows and held:
                left = left or kernel.Block.joined(held)
                yield from result().of(left, kernel.Block.of(other, dim), False, dim)
        if triangular and held and key[0].as_py() == key[1].as_py():
            slab = kernel.Block.joined(held)
            yield from result().of(slab, slab, True, dim)

    ship_package(tiled.sparkSession)
    tile = ("tile_row", "tile_col")
    return (
        tiled.select(*tile, "side", "idx", "norm_sq", "copies", "v")
        .repartition(max(1, min(2 * tiles, _MAX_TASKS)), *tile)
        .sortWithinPartitions(*tile, "side")
        .groupBy(*tile)
        .applyInArrow(score, result.schema)
    )


def _with_copies(frame: DataFrame) -> DataFrame:
    return frame if "copies" in frame.columns else frame.withColumn("copies", F.lit(1).cast("bigint"))


def _self_tiles(store: VectorStore, block_rows: int | None, result: type[_Cells] | type[_Sums]) -> DataFrame:
    """The tiles of a store with itself."""
    banded = _with_copies(_banded(store))
    counts = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    if block_rows is None:
        cores = banded.sparkSession.sparkContext.defaultParallelism
        block_rows = block_rows_for(sum(counts.values()), store.dim, cores)
    plan = _block_plan(counts, block_rows)
    tiles = sum(blocks * (high - low + 1) for _, _, blocks, low, high in plan) // 2 + len(plan)
    partner = F.explode(F.sequence("low", "high")).alias("partner")
    tiled = (
        _with_blocks(banded, plan)
        .select("*", partner)
        .withColumns({
            "tile_row": F.least("block", "partner"),
            "tile_col": F.greatest("block", "partner"),
            "side": F.when(F.col("block") <= F.col("partner"), 0).otherwise(1),
        })
    )
    return _join_tiles(tiled, store.dim, tiles, True, result)


def _ordered(found: DataFrame) -> DataFrame:
    """The smaller idx of every cell in row_idx."""
    swapped = F.col("row_idx") > F.col("col_idx")
    pick = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
    return found.select(
        pick("row_idx", "col_idx").alias("row_idx"),
        pick("col_idx", "row_idx").alias("col_idx"),
        "jaccard_raw",
        "q",
        pick("row_copies", "col_copies").alias("row_copies"),
        pick("col_copies", "row_copies").alias("col_copies"),
    )


def self_join(store: VectorStore, block_rows: int | None = None) -> DataFrame:
    """Existing cells with row_idx <= col_idx, self cells included.

    ``store.vectors`` may carry a ``copies`` column; it is passed on as
    ``row_copies`` and ``col_copies``.
    """
    return _ordered(_self_tiles(store, block_rows, _Cells))


def self_sums(store: VectorStore, block_rows: int | None = None) -> DataFrame:
    """(row_idx, n_cells, q_sum, self_q, row_copies) of every vector with a cell, both directions of the same cells.

    Other ends count by their copies. All pairs are compared, but cells are summed in the task that finds them, so what
    is shuffled is a row per vector and slab it meets.
    """
    parts = _self_tiles(store, block_rows, _Sums)
    return parts.groupBy("row_idx").agg(
        F.sum("n_cells").alias("n_cells"), F.sum("q_sum").alias("q_sum"), F.max("self_q").alias("self_q"), F.max("row_copies").alias("row_copies")
    )


def touching(store: VectorStore, wanted: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The cells of :func:`self_join` with an end in ``wanted`` (idx): wanted vectors against all others and among themselves."""
    ids = wanted.select("idx").distinct()
    own, others = (store.vectors.join(ids, "idx", how) for how in ("left_semi", "left_anti"))
    return _ordered(_facing_tiles(own, store.restrict(others), block_rows)).unionByName(self_join(store.restrict(own), block_rows))


def _facing_tiles(queries: DataFrame, store: VectorStore, block_rows: int | None) -> DataFrame:
    """The tiles of query blocks x store blocks."""
    dim = store.dim
    rows = _with_copies(_banded(store.restrict(queries))).withColumn("side", F.lit(0))
    cols = _with_copies(_banded(store)).withColumn("side", F.lit(1))
    counted = (
        rows.select("band", "side").unionAll(cols.select("band", "side"))
        .groupBy("band", "side").count().collect()
    )
    sizes = [{r["band"]: r["count"] for r in counted if r["side"] == s} for s in (0, 1)]
    if block_rows is None:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        block_rows = block_rows_for(sum(sizes[1].values()), dim, cores)
    # Both sides know all bands, so partner ranges are looked up in the other plan.
    bands = {band for size in sizes for band in size}
    plans = [
        {band: (start, blocks) for band, start, blocks, _, _ in
         _block_plan({b: size.get(b, 0) for b in bands}, block_rows)}
        for size in sizes
    ]

    def facing(own: int) -> list[tuple[int, int, int, int, int]]:
        other = plans[1 - own]
        result = []
        for band, (start, blocks) in plans[own].items():
            near = [other[b] for b in (band - 1, band, band + 1) if b in other]
            result.append((band, start, blocks, near[0][0], sum(near[-1]) - 1))
        return result

    placed = []
    for own, side in enumerate((rows, cols)):
        spread = _with_blocks(side, facing(own)).select(
            "idx", "norm_sq", "v", "side", "copies", "block",
            F.explode(F.sequence("low", "high")).alias("partner"),
        )
        mine, theirs = F.col("block"), F.col("partner")
        placed.append(spread.select(
            "idx", "norm_sq", "v", "side", "copies",
            (mine if own == 0 else theirs).alias("tile_row"),
            (theirs if own == 0 else mine).alias("tile_col"),
        ))
    tiles = sum(b * (h - low + 1) for _, _, b, low, h in facing(0))
    tiled = reduce(DataFrame.unionByName, placed)
    return _join_tiles(tiled, dim, tiles, triangular=False)


def block_pairs(
    queries: DataFrame, store: VectorStore, block_rows: int | None = None
) -> DataFrame:
    """Full rows of many queries: query blocks x store blocks, self excluded."""
    found = _facing_tiles(queries, store, block_rows)
    names = store.ids
    return (
        found.join(names.toDF("row_idx", "row_acc"), "row_idx")
        .join(names.toDF("col_idx", "col_acc"), "col_idx")
        .withColumn("jaccard_quantized", F.col("q").cast("int"))
        .select(*ROW_TRUTH_SCHEMA.names)
    )


def collapse_copies(store: VectorStore) -> tuple[VectorStore, DataFrame]:
    """One representative per group of identical vectors, and the memberships.

    A third of a store may be one vector; its cells would otherwise be
    computed and kept for every pair of copies. The content digest is counted
    map-side, so a hot group reaches the shuffle as one row per task.
    """
    content = F.concat_ws("|", F.col("norm_sq").cast("string"), F.array_join("v", ","))
    keyed = settle(store.vectors.select("idx", F.sha2(content, 256).alias("digest")))
    groups = keyed.groupBy("digest").agg(
        F.min("idx").alias("rep_idx"), F.count(F.lit(1)).alias("copies")
    )
    repeated = settle(groups.where("copies > 1"))
    members = join_grouped(keyed, repeated, "digest", "copies", "idx").select(
        "idx", "rep_idx", F.col("copies").alias("n_copies")
    )
    if repeated.isEmpty():
        one = F.lit(1).cast("bigint")
        return store.restrict(store.vectors.withColumn("copies", one)), members
    reps = groups.select(F.col("rep_idx").alias("idx"), "copies")
    vectors = store.vectors.join(reps, "idx")
    return store.restrict(vectors), members
