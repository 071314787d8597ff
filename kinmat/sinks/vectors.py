"""Vector stores and per-row lists as files (the written forms of SRC-1..SRC-3 and SRC-6)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from kinmat.model import VectorStore
from kinmat.session import ship_package
from kinmat.sources.vectors import Int32VectorSource, _open


def write_store(store: VectorStore, folder: str) -> None:
    """vectors.bin, vector_norms.txt and dimension.txt, as ``sources.vectors.open_store`` reads them.

    idx must be 0, 1, 2 and so on. Vectors and norms are folders of parts in the order of idx.
    """
    spark = store.vectors.sparkSession
    ship_package(spark)
    spark.dataSource.register(Int32VectorSource)
    folder = folder.rstrip("/")
    ordered = store.vectors.repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.select("idx", "v").write.format("int32_vectors").option("dimension", str(store.dim)).mode("overwrite").save(f"{folder}/vectors.bin")
    lines = ordered.select(F.concat_ws(" ", "acc", F.col("norm").cast("string")).alias("value"))
    lines.write.mode("overwrite").text(f"{folder}/vector_norms.txt")
    spark.createDataFrame([(str(store.dim),)], "value string").write.mode("overwrite").text(f"{folder}/dimension.txt")


@dataclass
class WrittenLists(WriterCommitMessage):
    """Names of the files of a task: as written, and final."""

    names: list[tuple[str, str]]


class RowListSource(DataSource):
    """``df.write.format("row_lists")``: one CSV file per row_acc, named after it.

    Rows must be clustered by row_acc, each in one partition. Options: ``path`` on storage all executors see, ``suffix``.
    """

    @classmethod
    def name(cls) -> str:
        return "row_lists"

    def writer(self, schema: T.StructType, overwrite: bool) -> "RowListWriter":
        return RowListWriter(self.options["path"], self.options.get("suffix", ".csv"))


class RowListWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenLists:
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        names, row, writer = [], None, None
        try:
            for batch in batches:
                accs = batch.column("row_acc").to_pylist()
                rest = batch.select([n for n in batch.schema.names if n != "row_acc"])
                cuts = [i for i in range(len(accs)) if i == 0 or accs[i] != accs[i - 1]]
                for low, high in zip(cuts, [*cuts[1:], len(accs)], strict=True):
                    if accs[low] != row or writer is None:
                        row = accs[low]
                        if row is None or "/" in row:
                            raise ValueError(f"{row} can be no file name")
                        if writer is not None:
                            writer.close()
                        names.append((f"{inner}/_{uuid.uuid4().hex}", f"{inner}/{row}{self.suffix}"))
                        writer = pacsv.CSVWriter(system.open_output_stream(names[-1][0]), rest.schema)
                    part = rest.slice(low, high - low)
                    # A row of nulls stands for an empty list, of which there is the header alone.
                    writer.write_batch(part.filter(pa.array(~np.array([v is None for v in part.column(0).to_pylist()]))))
        finally:
            if writer is not None:
                writer.close()
        return WrittenLists(names)

    def commit(self, messages: list[WrittenLists | None]) -> None:
        system, inner = _open(self.path)
        names = [n for m in messages if m is not None for n in m.names]
        if len({final for _, final in names}) != len(names):
            self.abort(messages)
            raise ValueError("rows of one row_acc must lie in one partition")
        system.create_dir(inner, recursive=True)
        for old in system.get_file_info(pafs.FileSelector(inner)):
            if old.base_name.endswith(self.suffix):
                system.delete_file(old.path)
        for written, final in names:
            system.move(written, final)

    def abort(self, messages: list[WrittenLists | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for written, _ in m.names if m is not None else ():
                system.delete_file(written)


def write_row_files(lists: DataFrame, path: str, suffix: str = ".csv") -> None:
    """One CSV file per row_acc, its entries by falling value; ``sources.text.read_neighbours`` reads them.

    A list goes through one task entry by entry and is never held. Nulls in the first column after row_acc stand for an empty list.
    """
    ship_package(lists.sparkSession)
    lists.sparkSession.dataSource.register(RowListSource)
    value = next(c for c in lists.columns if c.lower() in ("jaccard", "jaccard_raw"))
    placed = lists.repartition("row_acc").sortWithinPartitions("row_acc", F.desc(value))
    placed.write.format("row_lists").option("suffix", suffix).mode("append").save(path)
