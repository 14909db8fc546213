"""Reading named tables, and cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file, or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the setting is absent (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = "file://" + tempfile.mkdtemp(prefix="pagemill-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back.

    Survives the loss of any executor, is columnar (later readers prune), and is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(where)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(schema).parquet(where)
