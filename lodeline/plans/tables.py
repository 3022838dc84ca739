"""Access to the tables of a data directory, and session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as the cluster names it in spark.checkpoint.dir.

    A folder of our own is chosen only where the setting is absent and the master is local, as in tests;
    on a cluster a missing setting is an error, because a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "lodeline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df with cut lineage in the shared folder, so that a lost executor costs nothing."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


_KNOWN: set[str] = set()


def stage_dir(spark: SparkSession) -> str:
    """The folder of this application's stages, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        atexit.register(drop_stages, spark)
    return path


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as parquet into the shared folder and read it back: columnar, compressed, prunable."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Deletes what this application staged; call it between jobs of a long session, when their results are written."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is over, and with it the way to the folder
        return
