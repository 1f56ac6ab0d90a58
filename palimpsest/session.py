"""Session factory and table loader."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Applications whose executors have been sent this package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application, so that they can import it wherever the
    driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else the driver itself runs from a shipped copy
        path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch writes what it changed
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path of this application under spark.checkpoint.dir, which the cluster's hosts share, or, in a local session
    that names none, under /tmp/checkpoints; on a cluster the setting is required."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once under a ``fresh_path`` and read back, so that what made it runs once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What one Arrow batch to a Python worker may hold; the same for all operators, as plans of one session run later than
#: they are made. Operators that hold more than a few times a batch regroup rows by bytes themselves.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Make the session ready for Python workers: they get this package's code, and Arrow batches are bounded by rows and
    by bytes, so that long texts stay within a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
