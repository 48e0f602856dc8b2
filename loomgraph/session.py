"""Session helpers: building a session, shipping the package, shared scratch space."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, and rows that a scan decodes at once: texts are long.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 1024, 16 << 20, 256

#: Bytes of files that a task scans, and of a shuffle that a task is given, over a graph's tables: rows of numbers and
#: short ids take several times as much in memory.
SCAN_BYTES, SHUFFLE_BYTES = 8 << 20, 16 << 20
#: Bytes of the tables' files for each partition that a shuffle over them begins with; AQE joins those that turn out small.
SPREAD_BYTES = 4 << 20

_SHIPPED: set[str] = set()


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound what is decoded or sent to Python at once; a session that has larger bounds gets these."""
    bounds = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS,
    }
    for key, most in bounds.items():
        given = spark.conf.get(key)
        if not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(key, most)


def bound_tasks(spark: SparkSession) -> None:
    """Bound what a task scans or is given, so that more rows make more tasks; a session that has larger bounds gets these."""
    for key, most in {"spark.sql.files.maxPartitionBytes": SCAN_BYTES, "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_BYTES}.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def spread_shuffles(spark: SparkSession, size: int) -> None:
    """Shuffles over tables of this many bytes of files begin with partitions in proportion; a session that has more keeps them."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = -(-size // SPREAD_BYTES)
    if least > int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(key, str(least))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker (once per application), with bounded batches."""
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.realpath(os.path.join(tempfile.mkdtemp(), f"{root.name}.zip"))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Return memory that Python has freed to the system; the C library may keep it for a process's life."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder is made here if the application runs on one machine (tests);
    on a cluster, whose executors could not see it, that is an error.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), ignore_errors=True)
        context.setCheckpointDir(shared)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{context.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the folder of a materialized table that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
