"""Tables written once to the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401 - the operators' name for it

#: Used only where the session names no shared folder and runs in one process, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a local session has one; on a
    cluster a local folder would be another one on every host, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    return f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: the plan is cut, the rows are durable."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more: only once what was made from it is written itself."""
    folder = df.inputFiles()[0].rpartition("/")[0]
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that are still lazy read them, so write those first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
