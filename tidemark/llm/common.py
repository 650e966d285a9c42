"""Helpers shared by the training-data operators: written intermediate tables, skew-safe joins, global ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A key with at least one row in so many of a table's rows is hot; there can be no more hot keys than this.
HOT_KEYS = 1000
#: Over so many groups the rows of a hot key are dealt.
SALTS = 128

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

#: ASCII white space, the same six characters everywhere in this subpackage.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    # A written table replaces the shuffle files of its job, which would stay until the driver collects garbage.
    if spark.conf.get(_CLEANUP, "false") != "true":
        spark.conf.set(_CLEANUP, "true")
    short_batches(spark)
    return root.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers in batches of BATCH_ROWS at most, so that neither side holds many at a time."""
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Scratch:
    """Intermediate tables of an operator, written to the shared folder; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
        self.written: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str, **counted: Column) -> DataFrame | tuple:
        """Write ``df`` and read it again: cuts the lineage and survives lost executors.

        With ``counted`` (aggregates by name) the result is (table, values), gathered while the table is written.
        """
        path = f"{self.folder}/{label}-{uuid.uuid4().hex}"
        seen = Observation()
        observed = df.observe(seen, *[c.alias(n) for n, c in counted.items()]) if counted else df
        observed.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((table, path))
        return (table, seen.get) if counted else table

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table, path in self.written:
            if any(table is t for t in tables):
                there = jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(conf).delete(there, True)
        self.written = [w for w in self.written if not any(w[0] is t for t in tables)]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    return Scratch(df.sparkSession).write(df, label)


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, n_rows: int, weight: str, how: str = "inner") -> DataFrame:
    """Join many ``left`` rows with ``right``, which has one row per key, in one shuffle that no hot key can swamp.

    ``weight`` is the column of ``right`` that counts the left rows of its key; ``n_rows`` is the number of left rows.
    Keys with at least n_rows / HOT_KEYS rows number HOT_KEYS at most, so their list is broadcast; their left rows
    get one of SALTS salts and their right row is repeated for each salt.
    """
    least = max(2.0, n_rows / HOT_KEYS)
    is_hot = F.coalesce(F.col(weight) >= least, F.lit(False))
    hot = F.broadcast(right.where(is_hot).select(F.col(key).alias("_hot")))
    dealt = F.when(F.col("_hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", dealt).drop("_hot")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")


def with_global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 1 in a total order, without one task holding them all: range partitions plus offsets."""
    sliced = materialise(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ranked")
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return sliced.join(F.broadcast(offsets), "_slice").withColumn(name, inside + F.col("_before")).drop("_slice", "_before")


def unit_hash(*parts: Column) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of an MD5 digest; the same on every run and engine."""
    hexed = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
