"""Session helpers: the shared folder, intermediate tables written to it, table access."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go if a session on one machine names no shared folder (tests, notebooks).
OWN_CHECKPOINT_DIR = "/tmp/checkpoints"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = OWN_CHECKPOINT_DIR
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def forgotten(*frames: DataFrame | None) -> None:
    """Deletes the tables behind what written() returned; nothing may read them any more."""
    for df in frames:
        path = None if df is None else _paths.pop(df, None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
