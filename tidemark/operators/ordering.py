"""Orders that all runs share: global ranks, groups by their bytes with derived ids, and digests of whole outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import fail_where
from tidemark.functions.canonical import typed_bytes
from tidemark.functions.text import domain_hash, uuid8
from tidemark.operators.rowsets import Rowset
from tidemark.session import with_checkpoints
from tidemark.sources.tables import canonical_text

#: Digests that one digest of the next level stands for.
FAN = 1024
# Hash domains.
GROUP_DOMAIN, OUTPUT_DOMAIN = "group-row.v1", "output.v1"
_IN_PARTITION = 33  # bits of a row's place within its partition in Spark's increasing ids


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows from 0 in order, by ranges and their offsets; no task holds them all.

    Rows that the order leaves equal are numbered in any way, so give an order in which only rows that are alike are equal.
    """
    with_checkpoints(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_place")).checkpoint()
    part = F.shiftright("_place", _IN_PARTITION)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_place")


def output_digest(output: DataFrame, order: list[Column | str]) -> DataFrame:
    """(cardinality, sha256): one row that says whether two outputs are the same rows in the same order.

    The rows' canonical JSON is hashed, and FAN digests at a time are hashed in order until one is left, so the result depends
    on rows and order alone, not on how they are partitioned. Rows that ``order`` leaves equal are taken in the order of
    their JSON.
    """
    text = canonical_text(output).alias("_json")
    ranked = global_rank(output.select("*", text), [*[F.col(c) if isinstance(c, str) else c for c in order], F.col("_json")])
    level, count = ranked.select(F.col("rank"), F.sha2("_json", 256).alias("digest")), ranked.count()
    total = count
    while count > 1:
        part = F.call_function("div", F.col("rank"), F.lit(FAN)).alias("part")
        inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]), "")
        level = level.groupBy(part).agg(F.sha2(inside, 256).alias("digest")).select(F.col("part").alias("rank"), "digest")
        count = -(-count // FAN)
    top = level.agg(F.coalesce(F.max("digest"), F.lit("")).alias("digest"))
    return top.select(F.lit(total).cast("bigint").alias("cardinality"), domain_hash(OUTPUT_DOMAIN, F.concat(F.lit(f"{total}:"), "digest")).alias("sha256"))


def group_identity(rows: Rowset, *names: str) -> tuple[Column, Column]:
    """(bytes, id) of a row's group by named fields: the keys' typed bytes one after the other, and the id derived from them.

    Keys are equal if type, state and content are; an absent key fails the job, as in ``Rowset.group``. Bytes sort
    unsigned, from the left.
    """
    parts = []
    for name in names:
        value = rows[name]
        parts.append(fail_where(value.payload.isNull(), "invalid_group_key", typed_bytes(value), "binary"))
    tuple_bytes = F.concat(*parts) if parts else F.lit(b"")
    return tuple_bytes, uuid8(domain_hash(GROUP_DOMAIN, F.hex(tuple_bytes)))


def ordered_groups(rows: Rowset, *names: str) -> DataFrame:
    """(place, group_id, n_rows, first_row, keys ...): groups in the order of their keys' bytes."""
    key, identity = group_identity(rows, *names)
    held = rows.df.select(key.alias("_bytes"), identity.alias("group_id"), F.col(rows.row_id).alias("_row"), *[rows[n].payload.cast(rows[n].kind).alias(n) for n in names])
    groups = held.groupBy("_bytes", "group_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_row").alias("first_row"), *[F.first(n).alias(n) for n in names])
    ranked = global_rank(groups, [F.col("_bytes"), F.col("group_id")], "place")
    return ranked.select("place", "group_id", "n_rows", "first_row", *names)
