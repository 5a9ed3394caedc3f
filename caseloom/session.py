"""Session builder and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Paths of the tables this process wrote, until they are removed.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_PATHS: set[str] = set()


def build_session(app_name: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on; ``conf`` overrides them."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        settings |= {
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
        }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would lose data together with its machine.
    """
    context = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
              or context.getCheckpointDir())
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="caseloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage before iterative fits. A written table survives lost
    executors and, unlike a checkpoint, is still read column by column.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    _PATHS.add(path)
    return table


def remove_table(table: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``table``, once nothing reads it any more."""
    path = _WRITTEN.pop(table, None)
    if path is not None:
        remove_path(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove every table written so far; results that still read one must have been stored before."""
    for path in sorted(_PATHS):
        remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder below the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _PATHS.discard(path)
