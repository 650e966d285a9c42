"""Files as payloads: one row a file, none of them read beyond a limit of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_payloads(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """(doc_id, size, body) of the files under ``path``: the file's address, its bytes, and its text or null if it is over the limit.

    Sizes come from the listing of files. The limit is pushed to the scan, so a file over it is never opened, and none that is
    over it is parsed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.col("path").alias("doc_id")
    small = files.where(F.col("length") <= max_bytes).select(name, F.col("length").alias("size"), F.decode("content", "UTF-8").alias("body"))
    large = files.where(F.col("length") > max_bytes).select(name, F.col("length").alias("size"), F.lit(None).cast("string").alias("body"))
    return small.unionByName(large)


def sound_payloads(payloads: DataFrame, found: DataFrame) -> DataFrame:
    """The payloads without a finding."""
    return payloads.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
