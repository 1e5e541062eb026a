"""Spark session defaults and the shared scratch folder.

Nothing in the library needs a session built here: every operator takes the
session from the DataFrame it is given.  ``build_session`` only collects the
settings a data-grid job wants.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A shuffle whose recomputed output differs from the first attempt restarts its
    # consumers instead of mixing old and new rows.
    "spark.sql.shuffle.orderIndependentChecksum.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "weftgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; keyword values override or extend them (``_`` reads as ``.``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {key.replace("_", "."): str(value) for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders handed out, by application.
_FOLDERS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name below the folder that every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    session may fall back to a folder of this machine.  ``written_folders`` lists
    the names given out, ``delete_written`` removes what was written there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="weftgrid-")
    folder = f"{root.rstrip('/')}/{label}-{uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def written_folders(spark: SparkSession) -> list[str]:
    """Folders that operators of this application were given for intermediate tables, oldest first."""
    return list(_FOLDERS.get(spark.sparkContext.applicationId, []))


def delete_written(spark: SparkSession, folders: Sequence[str] | None = None) -> int:
    """Delete intermediate tables (all, or the given ones) once no frame that reads them is needed; how many were there."""
    known, gone = _FOLDERS.get(spark.sparkContext.applicationId, []), 0
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in written_folders(spark) if folders is None else folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone += bool(path.getFileSystem(settings).delete(path, True))
        if folder in known:
            known.remove(folder)
    return gone


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The copy cuts the lineage, stays readable when executors are lost and lets every
    later use read only the columns it needs.  ``delete_written`` removes it.
    """
    path = shared_folder(df.sparkSession, label)
    # A column without a type has no values and no place in a file.
    untyped = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    stored = df.drop(*untyped)
    stored.write.parquet(path)
    copy = df.sparkSession.read.schema(stored.schema).parquet(path)
    return copy.withColumns({name: F.lit(None) for name in untyped}).select(*df.columns) if untyped else copy


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan of few files over all cores before expensive work in the row.

    A scan with at least as many splits as there are cores is left alone, so large
    inputs are not shuffled.  Meant for frames read straight from files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def packed(df: DataFrame, splits: int = 64) -> DataFrame:
    """Fewer, longer tasks for a scan of many small files: ``splits`` each, but a task per core at least."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.coalesce(max(cores, -(-parts // splits))) if parts > cores else df
