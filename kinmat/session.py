"""Session defaults and lineage cuts."""

from __future__ import annotations

import contextlib
import contextvars
import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinmat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver runs.

    Needed once per session; harmless where executors have it installed.
    """
    context = spark.sparkContext
    if any(f.endswith("/kinmat.zip") for f in context.listFiles):
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    base = pathlib.Path(tempfile.mkdtemp(prefix="kinmat-")) / "kinmat"
    context.addPyFile(shutil.make_archive(str(base), "zip", root, "kinmat"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="kinmat-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def _run_folder(spark: SparkSession) -> str:
    """Where this application's settled tables lie."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinmat-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has settled; results that still read them become invalid."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[SparkSession]:
    """A block after which the settled tables are deleted; write results before it ends."""
    try:
        yield spark
    finally:
        release(spark)


#: Tables settled within the blocks of ``settled_apart`` that are open, the innermost block last.
_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """A block whose queries delete their shuffle files when they end; nothing reads those of a settled table again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def settled_apart(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, settled; all that it settles on the way is deleted."""
    scopes = _scopes.get()
    own: list[DataFrame] = []
    token = _scopes.set((*scopes, own))
    try:
        made = make()
        _scopes.reset(token)
        token = None
        return settle(made)
    finally:
        if token is not None:
            _scopes.reset(token)
        for table in own:
            discard(table)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder, and read it back.

    Used where a costly result feeds several branches of one plan, so that it
    is neither computed twice nor lost with an executor. An eager checkpoint
    would evaluate the plan twice and lose column pruning.
    """
    path = f"{_run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_path = path
    for scope in _scopes.get()[-1:]:
        scope.append(table)
    return table


def discard(table: DataFrame) -> None:
    """Delete one settled table that nothing reads any more; other tables are left alone."""
    path = getattr(table, "settled_path", None)
    if path:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def together(tables: list[DataFrame]) -> DataFrame:
    """Settled tables of one schema as a single one."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t.settled_path for t in tables])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input, read as a few splits, to all cores.

    Large inputs have splits enough and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
