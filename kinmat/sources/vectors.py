"""Vector stores from files and from embedding tables (SRC-1..SRC-3, SRC-10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from kinmat.functions.similarity import norm_of, squared
from kinmat.model import VectorStore
from kinmat.operators.kernel import vectors_of
from kinmat.session import settle, ship_package
from kinmat.sources.text import numbered_lines

_VALUE_BYTES = 4
_BATCH_ROWS = 4096
_PARTITION_BYTES = 64 << 20
_PART_SUFFIX = ".vectors"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str, dim: int) -> list[tuple[int, int, str]]:
    """(first index, one after the last, file) of a file of vectors, or of a folder of such files in the order of their names."""
    if dim < 1:
        raise ValueError("the dimension must be positive")
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    parts = [info]
    if info.type == pafs.FileType.Directory:
        listed = system.get_file_info(pafs.FileSelector(inner))
        parts = sorted((f for f in listed if f.base_name.endswith(_PART_SUFFIX)), key=lambda f: f.base_name)
    found, first = [], 0
    for part in parts:
        if part.size % (dim * _VALUE_BYTES):
            raise ValueError(f"{part.path}: {part.size} bytes are no whole number of {dim}-d vectors")
        last = first + part.size // (dim * _VALUE_BYTES)
        found.append((first, last, part.path))
        first = last
    return found


def record_count(path: str, dim: int) -> int:
    """Vectors in the file or folder; a file that ends inside a record is an error."""
    return max((last for _, last, _ in _files(path, dim)), default=0)


class IndexRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start = start
        self.stop = stop


class Int32VectorSource(DataSource):
    """``spark.read.format("int32_vectors")``: record i starts at byte 4 * dim * i.

    Options: ``path`` on storage all executors see, ``dimension``. Every
    partition is a range of indices and seeks to its start; conditions on
    ``idx`` narrow the ranges that are read. Written, it is a folder with a file of this form for each range of idx;
    its names have the order of the ranges, so that joined by name they are the whole file.
    """

    @classmethod
    def name(cls) -> str:
        return "int32_vectors"

    def schema(self) -> str:
        return "idx bigint, v array<int>"

    def reader(self, schema: T.StructType) -> "Int32VectorReader":
        return Int32VectorReader(self.options["path"], int(self.options["dimension"]))

    def writer(self, schema: T.StructType, overwrite: bool) -> "Int32VectorWriter":
        return Int32VectorWriter(self.options["path"], int(self.options["dimension"]), overwrite)


@dataclass
class WrittenRange(WriterCommitMessage):
    """What a task has written: idx from first to below last, in a file that has no final name yet."""

    first: int
    last: int
    name: str


class Int32VectorWriter(DataSourceArrowWriter):
    """Writes (idx, v), sorted by idx within each partition; all idx together must be 0, 1, 2 and so on.

    A task writes under a name of its own, so that one that runs twice does no harm; the commit only renames.
    """

    def __init__(self, path: str, dim: int, overwrite: bool):
        self.path, self.dim, self.overwrite = path, dim, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenRange:
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        name, first, last = f"{inner}/_{uuid.uuid4().hex}", 0, 0
        with system.open_output_stream(name) as stream:
            for batch in batches:
                idx = batch.column("idx").to_numpy()
                if not len(idx):
                    continue
                first = first if last else int(idx[0])
                last = last or first
                if (idx != np.arange(last, last + len(idx))).any():
                    raise ValueError(f"idx of a partition must be consecutive, {last} is missing or out of order")
                stream.write(np.ascontiguousarray(vectors_of(batch.column("v"), self.dim), dtype="<i4").tobytes())
                last += len(idx)
        return WrittenRange(first, last, name)

    def commit(self, messages: list[WrittenRange | None]) -> None:
        system, inner = _open(self.path)
        ranges = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        full = [m for m in ranges if m.last > m.first]
        ends = [0, *[m.last for m in full]]
        if [m.first for m in full] != ends[:-1]:
            self.abort(messages)
            raise ValueError("the partitions' idx do not follow each other from 0 on")
        system.create_dir(inner, recursive=True)
        for old in system.get_file_info(pafs.FileSelector(inner)):
            if old.base_name.endswith(_PART_SUFFIX):
                if not self.overwrite:
                    self.abort(messages)
                    raise FileExistsError(self.path)
                system.delete_file(old.path)
        for m in full:
            system.move(m.name, f"{inner}/{m.first:020d}{_PART_SUFFIX}")
        self.abort([m for m in ranges if m.last == m.first])

    def abort(self, messages: list[WrittenRange | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.name)


class Int32VectorReader(DataSourceReader):
    def __init__(self, path: str, dim: int):
        self.path = path
        self.dim = dim
        self.low = 0
        self.high = record_count(path, dim)
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if getattr(condition, "attribute", None) == ("idx",):
                self._narrow(condition)
            # Spark applies all of them again, ranges are only a superset.
            yield condition

    def _narrow(self, condition: Filter) -> None:
        if isinstance(condition, (EqualTo, In)):
            values = condition.value if isinstance(condition, In) else (condition.value,)
            chosen = {int(v) for v in values if v is not None}
            self.wanted = chosen if self.wanted is None else self.wanted & chosen
        elif isinstance(condition, GreaterThan):
            self.low = max(self.low, condition.value + 1)
        elif isinstance(condition, GreaterThanOrEqual):
            self.low = max(self.low, condition.value)
        elif isinstance(condition, LessThan):
            self.high = min(self.high, condition.value)
        elif isinstance(condition, LessThanOrEqual):
            self.high = min(self.high, condition.value + 1)

    def partitions(self) -> list[InputPartition]:
        step = max(1, _PARTITION_BYTES // (_VALUE_BYTES * self.dim))
        if self.wanted is not None:
            # Near ids share a range; what lies between is read and filtered away.
            ranges: list[list[int]] = []
            for i in sorted(i for i in self.wanted if self.low <= i < self.high):
                if ranges and i - ranges[-1][1] < _BATCH_ROWS and i - ranges[-1][0] < step:
                    ranges[-1][1] = i + 1
                else:
                    ranges.append([i, i + 1])
            return [IndexRange(*r) for r in ranges]
        return [
            IndexRange(start, min(start + step, self.high))
            for start in range(self.low, self.high, step)
        ]

    def read(self, partition: IndexRange) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for low, high, name in _files(self.path, self.dim):
            start, stop = max(low, partition.start), min(high, partition.stop)
            if start < stop:
                yield from self._read_file(system, name, low, start, stop)

    def _read_file(self, system: pafs.FileSystem, name: str, low: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        record = _VALUE_BYTES * self.dim
        with system.open_input_file(name) as stream:
            stream.seek((start - low) * record)
            for first in range(start, stop, _BATCH_ROWS):
                count = min(_BATCH_ROWS, stop - first)
                data = stream.read(count * record)
                if len(data) != count * record:
                    raise EOFError(f"{self.path} ended inside vector {first + len(data) // record}")
                values = pa.array(np.frombuffer(data, dtype="<i4"))
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * self.dim)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(first, first + count, dtype=np.int64)),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    names=["idx", "v"],
                )


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """SRC-1: (idx, v)."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Int32VectorSource)
    return spark.read.format("int32_vectors").option("dimension", str(dim)).load(path)


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: (idx, acc, norm, norm_sq); idx is the line number."""
    fields = F.split(F.trim("value"), r"\s+")
    return numbered_lines(spark, path).select(
        F.col("line").alias("idx"),
        fields[0].alias("acc"),
        fields[1].cast("double").alias("norm"),
    ).withColumn("norm_sq", squared(F.col("norm")))


def read_dimension(spark: SparkSession, path: str) -> int:
    """SRC-3: the one number of the file."""
    lines = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not lines or not lines[0]["value"].split()[0].isdigit() or int(lines[0]["value"].split()[0]) < 1:
        raise ValueError(f"{path} holds no positive dimension")
    return int(lines[0]["value"].split()[0])


def open_store(spark: SparkSession, folder: str, derived_norms: bool = False) -> VectorStore:
    """A folder with dimension.txt, vector_norms.txt and vectors.bin.

    Vectors and norms are joined once and settled in ranges of idx, so that later scans shuffle nothing.
    """
    folder = folder.rstrip("/")
    dim = read_dimension(spark, f"{folder}/dimension.txt")
    norms = read_norms(spark, f"{folder}/vector_norms.txt")
    lines = norms.count()
    records = record_count(f"{folder}/vectors.bin", dim)
    if not lines:
        raise ValueError(f"{folder} holds no vectors")
    if lines != records:
        raise ValueError(f"{folder}: {lines} norms but {records} vectors")
    vectors = read_vectors(spark, f"{folder}/vectors.bin", dim).join(norms, "idx")
    ordered = vectors.select("idx", "acc", "norm", "norm_sq", "v").repartitionByRange("idx").sortWithinPartitions("idx")
    return VectorStore(settle(ordered), dim, derived_norms)


def store_from_vectors(vectors: DataFrame, dim: int) -> VectorStore:
    """A store whose norms come from its own (idx, acc, v)."""
    with_norm = vectors.select("idx", "acc", norm_of(F.col("v")).alias("norm"), "v")
    complete = with_norm.withColumn("norm_sq", squared(F.col("norm")))
    return VectorStore(complete.select("idx", "acc", "norm", "norm_sq", "v"), dim, True)


def vectors_from_embeddings(
    embeddings: DataFrame, scale: float, id_column: str = "vec_id", value_column: str = "embedding"
) -> VectorStore:
    """SRC-10: integer vectors from a float embedding column."""
    first = embeddings.select(F.size(value_column).alias("d")).limit(1).collect()
    if not first:
        raise ValueError("the embedding table is empty")
    scaled = F.transform(
        value_column, lambda x: F.round(x.cast("double") * F.lit(float(scale))).cast("int")
    )
    vectors = embeddings.select(
        F.col(id_column).cast("bigint").alias("idx"),
        F.col(id_column).cast("string").alias("acc"),
        scaled.alias("v"),
    )
    return store_from_vectors(vectors, first[0]["d"])
