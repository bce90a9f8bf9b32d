"""Source trees as the ``files`` relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P

# Limits of a scan.
MAX_FILE_BYTES, MAX_FILES, MAX_BYTES, PROBE = 512_000, 6_000, 80_000_000, 1024


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = MAX_FILE_BYTES, depth: int = 1) -> DataFrame:
    """Files under ``root`` as scan_id (the first ``depth`` folders), path, size and content (null if the first PROBE bytes hold a zero).

    Size filters reach the listing, so larger files are not opened; files of binary extensions and in vendored folders are left out. Spark's listing follows no links out of the tree
    on stores that have none; on a local disk, links are to be left out of the tree that is read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        f = f.where(F.col("length") <= max_bytes)
    below = F.substring_index("path", root.rstrip("/").rsplit(":", 1)[-1] + "/", -1)
    parts = F.split(below, "/")
    binary = F.contains(F.substring("content", 1, PROBE), F.lit(bytearray(b"\x00")))
    text = F.when(~binary, F.make_valid_utf8(F.col("content").cast("string")))
    rows = f.select(F.array_join(F.slice(parts, 1, depth), "/").alias("scan_id"), F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))), "/").alias("path"), F.col("length").alias("size"), text.alias("content"))
    flag = P.flags(F.col("path"), P.language(F.col("path")))
    return rows.where(~flag["is_binary"] & ~flag["is_vendor"])


def within_limits(files: DataFrame, max_file_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (scan_id, path, size, ...) that a scan takes, in path order: files not too large, a number of them, and bytes in all.

    The number is cut in each partition before the shuffle, so at most ``max_files`` rows of a scan are summed in order.
    """
    own = Window.partitionBy("scan_id").orderBy("path")
    small = files.where(F.col("size") <= max_file_bytes).withColumn("place", F.row_number().over(own)).where(F.col("place") <= max_files)
    return small.withColumn("bytes", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("bytes") <= max_bytes).drop("place", "bytes")


def taken(files: DataFrame, **limits) -> DataFrame:
    """scan_id, kept, skipped, truncated."""
    kept = within_limits(files.select("scan_id", "path", "size"), **limits).groupBy("scan_id").agg(F.count("*").alias("kept"))
    n = files.groupBy("scan_id").agg(F.count("*").alias("n")).join(kept, "scan_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return n.select("scan_id", "kept", (F.col("n") - F.col("kept")).alias("skipped"), (F.col("kept") < F.col("n")).alias("truncated"))
