"""Exact de-duplication by skew-safe combining.

Three combining stages, each grouping by digest AND full normalised content, so a digest collision can never merge
two texts: (1) every input partition combines its own rows before anything is shuffled, (2) partial winners meet in
salted groups, so a text that holds a third of all rows is spread over SALTS groups, (3) the salts' winners meet once
more, at most SALTS rows a text.

Defined results: null text counts as empty; an empty table gives an empty result; a null doc_id loses every tie and may
be its group's keep_id only if all its rows have none; of rows that repeat both doc_id and text, exactly one is kept;
texts of any length are compared whole; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, skew_safe_join

#: A text's rows meet in so many groups before the last combining.
SALTS = 32
#: Winners' order as one number: code points of the original times _SPAN, plus a place that falls as the id grows.
_SPAN = 2**64 + 1


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _normaliser(digest: Callable[[bytes], str]):
    @F.pandas_udf("content binary, digest string")
    def normalise(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            content = [("" if t is None else t).encode("utf-8").translate(None, b" \t\n\x0b\x0c\r") for t in texts]
            yield pd.DataFrame({"content": content, "digest": [digest(c) for c in content]})

    return normalise


def _number(value: int):
    return F.lit(str(value)).cast("decimal(20,0)")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """One row per input row: the columns of ``carry`` (by default doc_id), keep_id, group_size, kept, text_digest."""
    carry = [doc_id] if carry is None else carry
    place = F.coalesce(_number(2**63) - F.col(doc_id).cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    order = (F.coalesce(F.length(text), F.lit(0)).cast("decimal(10,0)") * _number(_SPAN) + place).cast("decimal(38,0)")
    rows = docs.select(F.struct(*carry).alias("row"), order.alias("order"), _normaliser(digest)(F.col(text)).alias("n"))
    rows = rows.select("row", "order", "n.digest", "n.content")

    local = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    salted = local.groupBy("digest", "salt", "content").agg(F.max("order").alias("best"), F.count(F.lit(1)).alias("size"))
    groups = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
    scratch = Scratch(docs.sparkSession)
    groups = scratch.write(groups.select("digest", F.sha2("content", 512).alias("inner"), "best", "group_size"), "exact-groups")

    # Usually a digest has one content. If not, rows are matched by a second digest as well.
    n_rows = groups.agg(F.sum("group_size")).first()[0] or 0
    if groups.groupBy("digest").count().where("count > 1").limit(1).count():
        rows = rows.withColumn("match", F.concat("digest", F.sha2("content", 512)))
        groups = groups.withColumn("match", F.concat("digest", "inner"))
    else:
        rows, groups = rows.withColumn("match", F.col("digest")), groups.withColumn("match", F.col("digest"))
    joined = skew_safe_join(rows.drop("content"), groups.select("match", "best", "group_size"), "match", n_rows, "group_size")
    kept = F.col("order") == F.col("best")
    if docs.groupBy(doc_id).count().where("count > 1").limit(1).count():  # equal rows tie: the first of them stays
        joined = scratch.write(joined.withColumn("tied", kept).withColumn("uid", F.monotonically_increasing_id()), "exact-tied")
        first = joined.where("tied").groupBy("match").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("first"))
        joined = joined.join(first, "uid", "left")  # one row an id on both sides: no text is a single task's work
        kept = F.coalesce("first", F.lit(False))
    winner = F.col("best") % _number(_SPAN)
    keep_id = F.when(winner > 0, _number(2**63) - winner).cast("long")
    return joined.select("row.*", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_digest"))
