"""What the operators share: tables by name, and the folder that every executor can see.

Rows go through as they are: nulls, repeated rows and columns of any name stay, and an empty table is written and read
as one."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_ROWS = 2000
BROADCAST = 2_000_000  # ids of rows that go, 8 bytes each, which are sent to every executor; beyond it, a join by shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine, as in tests, a
    folder of our own is set; on a cluster no folder of the driver's would do, so there it raises ValueError."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='adjudica-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, folder)
    if SCRATCH:
        SCRATCH[-1].append(folder)
    return folder


SCRATCH: list[list[str]] = []  # for each scope that is open, the folders made within


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose tables go when it ends, but for those passed to what it yields. Whatever leaves the scope must
    read no other table of it, so that nothing that is gone is ever needed again, after a lost executor either."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._folder)
        return df

    SCRATCH.append([])
    try:
        yield keep
    finally:
        made = SCRATCH.pop()
        for folder in made:
            if folder not in kept:
                remove_folder(spark, folder)
        if SCRATCH:
            SCRATCH[-1].extend(f for f in made if f in kept)


def remove_folder(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone by now; a left folder does no harm
        return


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Within, Python gets batches of at most ``BATCH_ROWS`` rows, as texts are long and both sides hold whole batches;
    and what a write shuffled goes once it is done, as only the written table is read again."""
    rows, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {name: spark.conf.get(name) for name in (rows, clean)}
    most = int(before[rows])
    spark.conf.set(rows, str(min(BATCH_ROWS, most) if most > 0 else BATCH_ROWS))
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet into the shared folder and reads them back, so that a lost
    executor costs no recomputation of what stands above."""
    folder = fresh_folder(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def leave_out(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows whose id is not among ``gone.doc_id``, a written table, whose size is known: up to ``BROADCAST`` ids, the
    rows that stay are not moved."""
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    return df.join(gone, df[id_col] == gone["doc_id"], "left_anti")


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system. Workers stay for the stages that follow, and
    would hold what the largest batch took for as long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        return
