"""Text and CSV inputs (SRC-4..SRC-9)."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmat.constants import ABSENT, PRINTED_PREAMBLE
from kinmat.model import MANIFEST_SCHEMA, PAIR_TRUTH_SCHEMA

# Column layouts of one-file-per-row lists.
LIST_LAYOUTS = {
    "decoded": "id string, jaccard double",
    "truth": "col_acc string, jaccard_raw double, jaccard_quantized int",
    "truth_raw": "col_acc string, jaccard_raw double",
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the non-blank lines of one file, or of the files of a folder by name, counted from 0.

    ``zipWithIndex`` counts the lines of every split in one pass and numbers them in the next; files are given in
    the order of their names.
    """
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    schema = "line long, value string"
    if not files:
        return spark.createDataFrame([], schema)
    lines = spark.sparkContext.textFile(",".join(files)).filter(lambda line: line.strip(" ") != "")
    return spark.createDataFrame(lines.zipWithIndex().map(lambda at: (at[1], at[0])), schema)


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: one id per line, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("acc")).where("acc <> ''")


def read_pair_truth(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: pair truth; the value columns of absent pairs become NULL."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in ("row_acc", "col_acc", "should_exist", "jaccard_quantized") if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    typed = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in raw.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in PAIR_TRUTH_SCHEMA
    ]
    values = ("jaccard_raw", "jaccard_quantized")
    return raw.select(typed).withColumns({c: F.nullif(F.col(c), F.lit(ABSENT)) for c in values})


def read_neighbours(spark: SparkSession, folder: str, suffix: str = ".csv", layout: str = "decoded") -> DataFrame:
    """SRC-6: a folder of per-row files as one table keyed by row_acc."""
    name = F.col("_metadata.file_name")
    return (
        spark.read.schema(LIST_LAYOUTS[layout]).option("pathGlobFilter", f"*{suffix}")
        .csv(folder, header=True)
        .select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("row_acc"), "*")
    )


def list_rows(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """(row_acc) of all files of such a folder, files without entries included."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
        .select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("row_acc"))
    )


def read_exported_lists(spark: SparkSession, path: str, layout: str = "decoded") -> tuple[DataFrame, DataFrame]:
    """(entries, rows) of an export by ``sinks.tables.write_lists_by_row``.

    Entries are keyed by the folder of their row; rows (row_acc) also has those whose list is empty.
    """
    entries = (
        spark.read.schema(f"{LIST_LAYOUTS[layout]}, row_acc string")
        .option("basePath", f"{path}/lists")
        .csv(f"{path}/lists", header=True)
    )
    order = ["row_acc", *[c for c in entries.columns if c != "row_acc"]]
    return entries.select(*order), spark.read.schema("row_acc string").csv(f"{path}/rows", header=True)


def read_slice(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: wide CSV slice to (row_acc, col_acc, cell).

    Columns without any value, such as the one after a trailing comma, go.
    """
    wide = spark.read.csv(path, header=True)
    key, *names = wide.columns
    filled = wide.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(names)]).first()
    kept = [c for i, c in enumerate(names) if filled[i]]
    typed = wide.select(
        F.col(f"`{key}`").alias("row_acc"), *[F.col(f"`{c}`").cast("double").alias(c) for c in kept]
    )
    return typed.unpivot(["row_acc"], [F.col(f"`{c}`") for c in kept], "col_acc", "cell")


def read_printed_matrix(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: a printed, whitespace-aligned matrix to (row_acc, col_acc, cell)."""
    preamble = reduce(lambda a, b: a | b, [F.startswith(F.trim("value"), F.lit(p)) for p in PRINTED_PREAMBLE])
    lines = numbered_lines(spark, path).where(~preamble)
    first = lines.agg(F.min_by("value", "line").alias("header"), F.min("line").alias("line")).first()
    if first["header"] is None:
        raise ValueError(f"{path} holds no table")
    header = first["header"].split()
    tokens = F.split(F.trim("value"), r"\s+")
    # The header has no entry for the row ids, unless the index is named.
    named = F.array(*map(F.lit, header))
    columns = F.when(F.size(tokens) == len(header), F.slice(named, 2, len(header))).otherwise(named)
    cells = F.arrays_zip(columns.alias("col_acc"), F.slice(tokens, 2, len(header)).alias("cell"))
    return (
        lines.where(F.col("line") > first["line"])
        .select(tokens[0].alias("row_acc"), F.explode(cells).alias("pair"))
        .select("row_acc", F.col("pair.col_acc"), F.col("pair.cell").cast("double").alias("cell"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9."""
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True)
