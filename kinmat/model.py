"""Table layouts and the two handles the operators pass around."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NORM_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("acc", T.StringType()),
    T.StructField("norm", T.DoubleType()),
    T.StructField("norm_sq", T.DoubleType()),
])

PAIR_TRUTH_SCHEMA = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("col_idx", T.LongType()),
    T.StructField("row_acc", T.StringType()),
    T.StructField("col_acc", T.StringType()),
    T.StructField("should_exist", T.IntegerType()),
    T.StructField("jaccard_raw", T.DoubleType()),
    T.StructField("jaccard_quantized", T.IntegerType()),
])

ROW_TRUTH_SCHEMA = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("row_acc", T.StringType()),
    T.StructField("col_idx", T.LongType()),
    T.StructField("col_acc", T.StringType()),
    T.StructField("jaccard_raw", T.DoubleType()),
    T.StructField("jaccard_quantized", T.IntegerType()),
])

CELL_SCHEMA = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("col_idx", T.LongType()),
    T.StructField("jaccard_raw", T.DoubleType()),
    T.StructField("q", T.ShortType()),
])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("accession", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("target_jaccard", T.DoubleType()),
    T.StructField("indel_rate", T.DoubleType()),
    T.StructField("achieved_true_kmer_jaccard", T.DoubleType()),
    T.StructField("paired_with", T.StringType()),
])


@dataclass(frozen=True)
class VectorStore:
    """Vectors joined to their norms.

    ``vectors`` has (idx LONG, acc STRING, norm DOUBLE, norm_sq DOUBLE,
    v ARRAY<INT>); every ``v`` has ``dim`` entries. ``derived_norms`` says that
    ``norm_sq`` equals the sum of squares over ``dim``, which allows
    the lossless norm-ratio prune. A norm file may say otherwise, so it is off
    for those unless asked for.
    """

    vectors: DataFrame
    dim: int
    derived_norms: bool = False

    @property
    def ids(self) -> DataFrame:
        return self.vectors.select("idx", "acc")

    def restrict(self, vectors: DataFrame) -> "VectorStore":
        return VectorStore(vectors, self.dim, self.derived_norms)


@dataclass(frozen=True)
class StoredMatrix:
    """Thresholded 8-bit matrix over the distinct vectors of a store.

    ``cells``  (row_idx, col_idx, q, row_copies, col_copies): the triangle row_idx <= col_idx
    with the self cells, where identical vectors stand under their smallest idx. It is mirrored when read.
    ``copies`` (idx, rep_idx, n_copies): members of groups of identical vectors,
    only for groups of two or more.
    ``ids``    (idx, acc).
    ``reps``   the distinct vectors (with ``copies``) of a matrix whose cells are not kept yet; they are computed when read.
    ``rows``   (idx, acc) of the rows that are kept, each with all its cells; None for all rows.
    """

    cells: DataFrame
    copies: DataFrame
    ids: DataFrame
    reps: VectorStore | None = None
    rows: DataFrame | None = None
