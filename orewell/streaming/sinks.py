"""Streamed sinks that write each batch exactly once, over failures and restarts.

A batch is written to a folder of its own, named by the writer and the batch's number, which overwrites what a broken attempt left; then a line in the ledger makes it part of the table. Spark gives a batch
that is run again the same number and the same rows as long as the checkpoint is kept. Readers see the batches of the ledger only. A new checkpoint needs a new writer's name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LEDGER = "writer string, batch long, rows long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> DataFrame:
    """writer, batch, rows of the batches that are part of the table; one small file for each."""
    fs, at = _fs(spark, f"{path}/_ledger")
    return spark.read.schema(LEDGER).json(f"{path}/_ledger") if fs.exists(at) else spark.createDataFrame([], LEDGER)


def _commit(spark: SparkSession, path: str, writer: str, batch: int, rows: int) -> None:
    """One file, written under another name and renamed, so that it is there as a whole or not at all."""
    fs, part = _fs(spark, f"{path}/_ledger/.{writer}-{batch}.new")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"writer": writer, "batch": batch, "rows": rows}) + "\n", "utf-8"))
    out.close()
    if not fs.rename(part, _fs(spark, f"{path}/_ledger/{writer}-{batch}.json")[1]):
        raise OSError(f"batch {batch} of {writer} has no place in the ledger of {path}")


def write_batch(path: str, writer: str, keys: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch once, with one row for each value of ``keys``, and nothing if the ledger has it."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fs, done = _fs(spark, f"{path}/_ledger/{writer}-{batch}.json")
        if fs.exists(done):
            return
        to = f"{path}/writer={writer}/batch={batch}"
        (rows.dropDuplicates(list(keys)) if keys else rows).write.mode("overwrite").parquet(to)
        _commit(spark, path, writer, batch, spark.read.schema(rows.schema).parquet(to).count())

    return write


def start(rows: DataFrame, path: str, marks: str, writer: str = "w", keys: tuple[str, ...] = (), mode: str = "append", **trigger) -> StreamingQuery:
    """Starts the stream ``rows`` into the table at ``path``; ``marks`` is its checkpoint. Without a trigger it takes what is there and ends."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", marks).foreachBatch(write_batch(path, writer, keys)).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches in the ledger; the folders of others are not read."""
    rows = spark.read.schema(schema).option("basePath", path)
    found = [f"{path}/writer={r['writer']}/batch={r['batch']}" for r in committed(spark, path).select("writer", "batch").toLocalIterator()]
    return rows.parquet(*found).drop("writer", "batch") if found else spark.createDataFrame([], schema)


def latest(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """For a table of versions, such as reports: the row of each key that the last batch with it wrote."""
    from pyspark.sql import functions as F

    found = [f"{path}/writer={r['writer']}/batch={r['batch']}" for r in committed(spark, path).select("writer", "batch").toLocalIterator()]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(*found)
    whole = spark.createDataFrame([], schema).columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*whole), F.struct(F.col("batch").cast("long"), "writer")).alias("x")).select("x.*")
