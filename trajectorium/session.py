"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


#: Bytes of an Arrow batch on its way to a Python worker. Spark's own bound holds 10,000 rows of text, in the executor's buffers and once more in the worker.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, for Python functions there, which get their rows in batches of bounded size unless the application sets another one."""
    sc = spark.sparkContext
    if sc.getConf().get(_BATCH_CONF) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    if getattr(sc, "_trajectorium_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT.parent)))
    folder = tempfile.mkdtemp(prefix="trajectorium-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "trajectorium_package.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    sc._trajectorium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all of Spark runs in this process, else an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_trajectorium_shared", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trajectorium-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = sc._trajectorium_shared = "file://" + folder
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all(spark: SparkSession) -> None:
    """What is left of this session's tables, if Spark still runs."""
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            for path in list(spark.sparkContext._trajectorium_tables):
                _delete(spark, path)


def materialize(df: DataFrame, name: str = "table", dealt: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. The table goes with discard(), or when the driver ends.

    dealt: joins deal the table over tasks. Spark takes a table for as large as its
    files, which hold ids and arrays many times smaller than memory does, and would
    send it whole through the driver.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if dealt:
        table = table.hint("merge")
    sc = spark.sparkContext
    if not hasattr(sc, "_trajectorium_tables"):
        sc._trajectorium_tables = set()
        atexit.register(_delete_all, spark)
    sc._trajectorium_tables.add(path)
    table._trajectorium_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        path = t._trajectorium_path
        _delete(t.sparkSession, path)
        t.sparkSession.sparkContext._trajectorium_tables.discard(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions. For groups that take Python long though their rows are few: Spark would put such partitions together by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
