"""A Parquet store of runs: append-only tables, latest-version views, idempotent batches, resume, exports.

Parquet has no MERGE. Tables are append-only and a view takes the last version of each key. A batch is written to folders
of its own attempt, in all its tables, and then a record of it is renamed into the commit log; readers see what a record
names and nothing else, so a batch appears in all its tables at once or in none, whatever is retried or dies.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.evaluate import latest_attempts

#: Key and version columns of every table.
TABLES = {
    "runs": (["run"], ["version"]),
    "samples": (["run", "question"], ["attempt", "id"]),
    "calls": (["sample", "call", "attempt"], ["id"]),
    "states": (["sample", "step"], ["id"]),
    "memory": (["sample", "event_id"], ["version"]),
    "records": (["sample", "record_ref"], ["version"]),
    "batches": (["sample", "batch"], ["version"]),
    "claims": (["sample", "claim_id"], ["version"]),
    "edges": (["sample", "edge_id"], ["version"]),
    "projections": (["sample", "ordinal"], ["version"]),
    "compactions": (["sample", "compaction"], ["version"]),
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        if table not in TABLES:
            raise ValueError(f"no table {table}")
        rows.write.mode("append").parquet(f"{self.path}/{table}")

    def _file(self, name: str):
        """(file system, path) of a name in the store."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(conf), path

    def has(self, name: str) -> bool:
        fs, path = self._file(name)
        return fs.exists(path)

    def commits(self) -> DataFrame:
        """(batch_id, version, attempt, tables, input_hash): a row per committed write of a batch."""
        schema = "batch_id long, version long, attempt string, tables array<string>, input_hash string"
        return self.spark.read.schema(schema).json(f"{self.path}/_commits") if self.has("_commits") else self.spark.createDataFrame([], schema)

    def log(self, table: str) -> DataFrame:
        """All versions of what is committed; columns that were added later are null in older rows."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}")
        if "attempt" not in rows.columns or "batch_id" not in rows.columns:
            return rows
        known = self.commits().filter(F.array_contains("tables", table))
        last = known.groupBy("batch_id").agg(F.max_by("attempt", "version").alias("attempt"))
        return rows.join(last, ["batch_id", "attempt"], "left_semi").drop("attempt")

    def view(self, table: str) -> DataFrame:
        """The last version of each key."""
        return latest_attempts(self.log(table), *TABLES[table])

    def append_batch(self, batch_id: int, input_hash: str | None = None, **tables: DataFrame) -> bool:
        """Write a batch's tables, all or none, for foreachBatch and for resumed runs; whether anything was written.

        With ``input_hash`` a batch that is committed with the same hash is left as it is, and one with another hash is an
        error. Without, a batch that comes again takes the place of its earlier write, at once in all its tables."""
        before = self.commits().filter(F.col("batch_id") == batch_id).select("version", "input_hash").collect()  # one row per retry
        stored = {r["input_hash"] for r in before if r["input_hash"] is not None}
        if input_hash is not None and stored:
            if stored != {input_hash}:
                raise ValueError(f"batch {batch_id} is stored with another input")
            return False
        attempt = f"a-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.drop("batch_id", "attempt").write.parquet(f"{self.path}/{name}/batch_id={batch_id}/attempt={attempt}")
        version = max([r["version"] for r in before], default=0) + 1
        record = {"batch_id": batch_id, "version": version, "attempt": attempt, "tables": sorted(tables), "input_hash": input_hash}
        fs, draft = self._file(f"_commits/_{attempt}")  # names that begin so are no records yet
        out = fs.create(draft)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        _, final = self._file(f"_commits/{batch_id}-{version}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise ValueError(f"batch {batch_id} was committed by another writer")
        return True

    def pending(self, wanted: DataFrame, fingerprint: str) -> DataFrame:
        """Of wanted (run, question) those that no attempt under this fingerprint has finished."""
        done = self.log("samples").filter(F.col("status").isin("completed", "not_runnable") & (F.col("fingerprint") == fingerprint))
        return wanted.join(done.select("run", "question"), ["run", "question"], "left_anti")

    def hypotheses(self, run: str) -> DataFrame:
        """(question_id, hypothesis) of each question's last completed attempt."""
        done = self.log("samples").filter((F.col("run") == run) & (F.col("status") == "completed"))
        latest = latest_attempts(done, ["question"], ["id"])
        return latest.select(F.col("question").alias("question_id"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))

    def check_batches(self, rows: DataFrame) -> None:
        """An ordinal that comes again must come with the same input."""
        known = self.log("batches").select("sample", "batch", F.col("input_hash").alias("known"))
        if not rows.join(known, ["sample", "batch"]).filter(F.col("known") != F.col("input_hash")).isEmpty():
            raise ValueError("a stored batch came again with another input")

    def assert_unique(self, table: str, *keys: str) -> None:
        if not self.log(table).groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{table} repeats {keys}")


def next_ordinals(rows: DataFrame, table: DataFrame, key: str, ordinal: str, order: str) -> DataFrame:
    """Adds ordinals behind the highest that the table has for the key."""
    from pyspark.sql import Window

    top = table.groupBy(key).agg(F.max(ordinal).alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.join(top, key, "left").withColumn(ordinal, F.coalesce("_top", F.lit(0)) + n).drop("_top")
