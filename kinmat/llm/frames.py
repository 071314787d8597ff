"""Small helpers for tables of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import from_arrow_type

from kinmat.session import ship_package

#: Bytes of text that a Python worker holds as objects at a time.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch; long texts make larger numbers costly.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a size that also holds very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value, body: Callable):
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def apart(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all but the needed columns under names that no operator uses, and what gives the names back."""
    hidden = {c: c if c in needed else f"__own_{i}__" for i, c in enumerate(df.columns)}
    renamed = df.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    return renamed, lambda out: out.select(*[F.col(h).alias(c) for c, h in hidden.items()])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a few MB of text; one longer text is a piece by itself."""
    texts = batch.column(column)
    start = size = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and size + (length or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[list[str]], dict[str, Iterable]]],
    added: pa.Schema,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from the text of each row, in Arrow batches.

    ``make`` is called once per task and returns the function from texts to columns. A
    null text counts as empty. The columns ``keep``, all by default, stay; those named as an added one are replaced.
    """
    spark = df.sparkSession
    ship_package(spark)
    small_batches(spark)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in added.names}]
    read = column if column in kept else "__text__"
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{column}`").alias(read)] * (read not in kept))
    source = source.withColumn(read, F.col(f"`{read}`").cast("string"))
    schema = source.select(*kept).schema
    for field in added:
        schema = schema.add(field.name, from_arrow_type(field.type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, read):
                found = work([t or "" for t in part.column(read).to_pylist()])
                arrays = [part.column(n) for n in kept] + [pa.array(found[f.name], type=f.type) for f in added]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added.names])

    return source.mapInArrow(run, schema)
