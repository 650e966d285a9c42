"""Linking the nodes of buckets without listing the pairs of a bucket. DataFrame functions only.

A bucket's members are first compared with one hub only, the one of least weight (the smallest set has the least of its
own beside what a bucket shares). Union-find merges what is confirmed, and only buckets that still hold several
components matter from then on: of small ones the pairs across components are compared, larger ones are left to the
caller's exact way. A pair that shares a bucket is thus compared, or joined by others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components

#: A mixed bucket of more members is large.
SMALL_BUCKET = 16


def with_hubs(dealt: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (bucket, node) of ``dealt`` (bucket, node, weight) whose bucket has several, with its lightest as ``hub``."""
    order = F.col("weight") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
    buckets = dealt.groupBy("bucket").agg(F.min_by("node", order).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = scratch.write(buckets.select("bucket", "hub"), "buckets")
    # Both sides of the join are shuffled, so adaptive execution splits the partitions of large buckets. Buckets are few and
    # short beside their members, so a task hashes its own rather than sorting all members.
    members = scratch.write(dealt.select("bucket", "node").join(buckets.hint("shuffle_hash"), "bucket"), "members")
    scratch.drop(buckets)
    return members


def mixed_members(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (bucket, node, component, size) of the ``members`` (bucket, node, component) of buckets that hold several components."""
    kinds = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    kinds = scratch.write(kinds.where("low <> high").select("bucket", "size"), "kinds")
    mixed = scratch.write(members.join(kinds, "bucket"), "mixed")
    scratch.drop(kinds)
    return mixed


def cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components within a bucket."""
    one = members.selectExpr("bucket", "node AS a", "component AS component_a")
    two = members.selectExpr("bucket", "node AS b", "component AS component_b")
    return one.join(two, "bucket").where("component_a < component_b").select("a", "b").distinct()


def absorb(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, component) after more links (a, b): union-find over the components that the links join."""
    for end in ("a", "b"):
        at = found.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
        links = links.join(at, end, "left").withColumn(f"component_{end}", F.coalesce(f"component_{end}", end))
    links = scratch.write(links.select("a", "b", "component_a", "component_b"), "joined")
    merged = connected_components(links.selectExpr("component_a AS a", "component_b AS b")).selectExpr("node AS component", "component AS merged")
    ends = links.selectExpr("a AS node", "component_a AS component").union(links.selectExpr("b AS node", "component_b AS component"))
    everyone = found.union(ends).distinct()
    return scratch.write(everyone.join(scratch.write(merged, "merged"), "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "components")


def link_buckets(members: DataFrame, compare: Callable[..., DataFrame], link_large: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Components (node, component) of nodes with links, from ``members`` as with_hubs gives them.

    ``compare`` confirms pairs (a, b), if it is told so only the likeliest of each a; ``link_large`` finds links (a, b)
    that join the components of (bucket, node, component, size), rows of large mixed buckets.
    """
    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    found = scratch.write(connected_components(compare(stars, True)), "components")
    placed = members.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = mixed_members(scratch.write(placed, "placed"), scratch)
    small, large = mixed.where(F.col("size") <= SMALL_BUCKET), mixed.where(F.col("size") > SMALL_BUCKET)
    return absorb(found, compare(cross_pairs(small)).union(link_large(large)), scratch)
