"""Session settings that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that every executor can read; the session names it in ``spark.checkpoint.dir``.

    Only a session on one machine that names none, as in tests, gets a temporary folder, which goes when Python ends; on a cluster
    that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vistaforge-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and go on from the written rows (reliable checkpoint)."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that the size of the files is known to the planner:
    it is broadcast in later joins if it is below ``spark.sql.autoBroadcastJoinThreshold``, and shuffled if not. With ``by``, rows are
    shuffled so that those with equal values there are in files of their own.

    The tables of an application are in one folder, which ``forget_written`` removes; plans that read them cannot run afterwards."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def forget_written(spark: SparkSession) -> None:
    """Remove all that ``written`` wrote for this application."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
