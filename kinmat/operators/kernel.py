"""The cell rule on two blocks of vectors inside one task (SIM-2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from kinmat.constants import EXIST_FRACTION, QUANT_LEVELS

STRIP_CELLS = 4_000_000


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column as a (rows, dim) matrix."""
    values = column.flatten()
    if len(values) != len(column) * dim or values.null_count or column.null_count:
        raise ValueError(f"every vector must have {dim} values")
    lengths = np.diff(column.offsets.to_numpy())
    if not np.all(lengths == dim):
        raise ValueError(f"every vector must have {dim} values")
    return values.to_numpy().reshape(-1, dim)


@dataclass(frozen=True)
class Block:
    """Vectors of some rows with what the cell rule and its result need of them."""

    idx: np.ndarray
    norm_sq: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, dim: int) -> Block:
        columns = (batch.column(c).to_numpy() for c in ("idx", "norm_sq", "copies"))
        return cls(*columns, vectors_of(batch.column("v"), dim))

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        if len(blocks) == 1:
            return blocks[0]
        parts = ((b.idx, b.norm_sq, b.copies, b.vectors) for b in blocks)
        return cls(*(np.concatenate(p) for p in zip(*parts)))


def _largest_norm(block: np.ndarray) -> float:
    wide = block.astype(np.float64)
    return float(np.sqrt(np.einsum("ij,ij->i", wide, wide).max(initial=0.0)))


def exact_dtype(left: np.ndarray, right: np.ndarray) -> type:
    """Cheapest type in which every partial sum of every dot product is exact."""
    bound = 1.001 * _largest_norm(left) * _largest_norm(right)
    if bound < 2**24:
        return np.float32
    if bound < 2**53:
        return np.float64
    if bound >= 2**63:
        raise OverflowError("dot products of these vectors exceed 64 bits")
    return np.int64


def quantise(jaccard: np.ndarray) -> np.ndarray:
    scaled = jaccard * QUANT_LEVELS
    whole = np.trunc(scaled)
    return (whole + np.copysign(np.abs(scaled - whole) >= 0.5, scaled)).astype(np.int32)


def cell_values(dots: np.ndarray, row_sq: np.ndarray, col_sq: np.ndarray, dim: int):
    """(exists, jaccard) of listed cells; ``dots`` is int64."""
    total = row_sq + col_sq
    truncated = np.where(dots >= 0, dots // dim, -((-dots) // dim))
    exists = truncated.astype(np.float64) > EXIST_FRACTION * total
    inter = dots.astype(np.float64) / dim
    with np.errstate(divide="ignore", invalid="ignore"):
        jaccard = np.minimum(inter / (total - inter), 1.0)
    return exists, jaccard


def existing_cells(
    left: np.ndarray, left_sq: np.ndarray, right: np.ndarray, right_sq: np.ndarray, dim: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (i, j, jaccard) of the existing cells, strip by strip.

    The matrix product is compared once with a slightly lowered threshold; only
    survivors go through the exact rule.
    """
    if not len(left) or not len(right):
        return
    dtype = exact_dtype(left, right)
    columns = np.ascontiguousarray(right.astype(dtype).T)
    loose = EXIST_FRACTION * dim * (1 - 1e-6)
    step = max(1, STRIP_CELLS // len(right))
    for start in range(0, len(left), step):
        rows = left[start : start + step].astype(dtype)
        dots = rows @ columns
        row_sq = left_sq[start : start + step]
        i, j = np.nonzero(dots >= loose * (row_sq[:, None] + right_sq[None, :]))
        exact = dots[i, j].astype(np.int64)
        exists, jaccard = cell_values(exact, row_sq[i], right_sq[j], dim)
        yield i[exists] + start, j[exists], jaccard[exists]


def every_cell(
    left: np.ndarray, left_sq: np.ndarray, right: np.ndarray, right_sq: np.ndarray, dim: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (i, j, exists, jaccard) of all cells, strip by strip."""
    if not len(left) or not len(right):
        return
    dtype = exact_dtype(left, right)
    columns = np.ascontiguousarray(right.astype(dtype).T)
    step = max(1, STRIP_CELLS // len(right))
    for start in range(0, len(left), step):
        dots = (left[start : start + step].astype(dtype) @ columns).astype(np.int64)
        i, j = np.divmod(np.arange(dots.size), len(right))
        exists, jaccard = cell_values(dots.ravel(), left_sq[start + i], right_sq[j], dim)
        yield i + start, j, exists, jaccard
