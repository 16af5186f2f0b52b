"""What the operators share: the shared folder, reading tables, and checks of columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, one of this machine's, if Spark runs on this machine alone, as in tests; else a ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='weft-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of a batch that goes to Python, so that rows as wide as two long documents' sets don't fill an executor.
BATCH_ROWS = 1 << 10


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of few rows, in what runs meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before) if int(before) > 0 else BATCH_ROWS, BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def releasing(run: Callable) -> Callable:
    """run over batches, after which the worker, which waits for other tasks, gives free memory back."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # other C libraries have no such call
                pass

    return out


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in upper or lower case: those given, behind as many underscores as that takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


class Stored:
    """Tables written into one run's folder within the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/weft-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver's
        next collection of garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str | None = None) -> None:
        """Deletes a table, or all of them, once nothing reads it any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)




#: Rows of ids, or short lists of them, that are broadcast at most; beyond it the same join shuffles.
BROADCAST_ROWS = 1 << 18


def small(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has ``limit`` rows or fewer."""
    return F.broadcast(stored) if stored.limit(limit + 1).count() <= limit else stored


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; a ValueError names any that's missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*[f"`{n}`" for n in names])
