"""Session settings the library relies on, and the one way it cuts lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: partition counts and memory belong to the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A fact joined to a dimension on a hot key must be split even where that costs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batches for Python are bounded by bytes too: ten thousand long texts are no batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A new folder of this application below the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``cut_lineage`` writes within the block goes when it ends, and so do shuffle files that nothing refers to any more.

    Yields a ``cut_lineage`` whose tables outlive the block, as long as those of the block around it.  Nothing that is read after
    the block may rest on its other tables.  They hold whole texts several times over, so they are packed more tightly.
    """
    outer, folder = _SCRATCH.get(), work_folder(spark)

    def keep(df: DataFrame) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return cut_lineage(df)
        finally:
            _SCRATCH.reset(inner)

    token = _SCRATCH.set(folder)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        _remove(spark, folder)
        release_shuffles(spark)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_dictionaries(spark: SparkSession) -> None:
    """Let written columns keep their dictionary up to 32 MB, for values that repeat over many rows.

    Beyond 1 MB, some hundred texts or a hundred thousand ids, a parquet file would hold every repeat in full.  Columns whose values
    do not repeat lose their dictionary after the first page as before.
    """
    spark.conf.set("parquet.dictionary.page.size", str(32 << 20))


def long_rows(spark: SparkSession) -> None:
    """Let the parquet writer look at what it holds after every few rows.

    It guesses from the rows so far when to look again, up to 10,000 rows later.  Where short rows are followed by rows of a
    megabyte that is gigabytes in a task.
    """
    for unit in ("page", "block"):
        spark.conf.set(f"parquet.{unit}.size.row.check.min", "8")
        spark.conf.set(f"parquet.{unit}.size.row.check.max", "8")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and carry on from the written table.

    A parquet table rather than a checkpoint: the next plan starts from real file sizes, reads
    only the columns it needs, and carries nothing over from the plan behind it.
    """
    spark, folder = df.sparkSession, _SCRATCH.get()
    path = f"{folder}/{uuid.uuid4().hex}" if folder else work_folder(spark)
    df.write.parquet(path, compression="zstd" if folder else None)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    It does so only when the driver collects garbage, and a driver that plans and waits may not do that before the disk is full.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove_work(spark: SparkSession) -> None:
    """Remove what this application wrote to its work folders; call it when no result is read any more."""
    _remove(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
