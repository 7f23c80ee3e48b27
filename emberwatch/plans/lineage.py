"""Pin an intermediate result on shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the plans rely on.

    Times are UTC. Parsing is one long projection: above 8000 bytes of code the JVM would run the
    fused method interpreted, so Spark is told to split it instead.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session without one (as in tests) gets its own; executors of a cluster could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="emberwatch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)  # a path is only marked if it is there
    system.deleteOnExit(place)
    return path


def release(pinned: DataFrame) -> None:
    """Delete a pinned table that nothing reads any more, in jobs that run for long."""
    spark = pinned.sparkSession
    for file in pinned.inputFiles()[:1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def pin(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps neither recompute it nor depend on executors that may be lost, and the planner
    knows its size, unlike that of an RDD checkpoint. ``release`` asks the driver for a garbage
    collection, on which Spark deletes the shuffle files that the table makes superfluous.
    """
    spark = df.sparkSession
    path = scratch(spark, "pinned")
    df.write.mode("overwrite").parquet(path)
    schema = df.schema
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
