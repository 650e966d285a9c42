"""Parquet tables with states, and canonical JSON out of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered(column, kind: T.DataType):
    """A value whose structs have their fields in order of name, at every depth."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_ordered(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _ordered(x, kind.elementType))
    return column


def canonical_text(df: DataFrame) -> Column:
    """A row of ``df`` as JSON text with sorted keys: equal rows have equal texts."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_ordered(F.col(f.name), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def canonical_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as canonical JSON text and its SHA-256."""
    return df.select(canonical_text(df).alias(out)).withColumn("sha256", F.sha2(out, 256))


def write_canonical(df: DataFrame, path: str) -> None:
    canonical_json(df).select("json").write.text(path)
