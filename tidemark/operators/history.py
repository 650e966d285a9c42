"""Versioned documents in append-only tables: heads, recent lists, content addresses and compare-and-append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import CalculationError


class Conflict(CalculationError):
    """The head moved since it was read."""

    def __init__(self, key: str):
        ValueError.__init__(self, f"revision conflict: {key}")
        self.code = "conflict"


def heads(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with the content of the version that is their head."""
    return documents.join(versions, (documents["id"] == versions["document_id"]) & (documents["tenant"] == versions["tenant"]) & (documents["head"] == versions["version"])).select(documents["id"], documents["tenant"], documents["head"], versions["content"], versions["sha256"])


def recent(documents: DataFrame, n: int) -> DataFrame:
    """The newest documents; ids settle ties."""
    if not 1 <= n <= 100:
        raise CalculationError("limit_exceeded", "1 to 100 documents")
    return documents.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def addressed(rows: DataFrame, content: str = "content") -> DataFrame:
    return rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def corrupted(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose stored digest isn't that of their content."""
    return rows.where(F.sha2(F.col(content).cast("binary"), 256) != F.col("sha256"))


def for_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    return rows.where(F.col("tenant") == tenant)


def append_version(path: str, rows: DataFrame, expected_head: int) -> int:
    """Append one version of a document folder, if its head is still the expected one. One writer per document.

    ``rows`` has document_id, tenant, content. Versions lie in folders version=N, so heads are found without a scan.
    """
    spark = rows.sparkSession
    try:
        head = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        head = 0
    if head != expected_head:
        raise Conflict(path)
    addressed(rows).withColumn("version", F.lit(head + 1)).write.mode("append").partitionBy("version").parquet(path)
    return head + 1
