"""Distributed union-find: connected components of an edge table by hooking and pointer jumping. DataFrame functions only.

Every node hooks on the least of its smaller neighbours. Parents are smaller than their children, so the hooks are a
forest; pointer jumping makes each node's parent its root, in about log2 of the depth steps. The edges are then drawn
between roots, and the next round hooks those, until no edge is left; in a round only roots with no smaller neighbour
remain.

Least neighbours combine before the shuffle. The joins look up one row a key, and both their sides are written tables,
so adaptive execution can split the partition of a root or hub that a third of all rows name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _to_roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``parents`` (node, parent) with the root of its tree as each node's parent."""
    parents = scratch.write(parents, "hooks")
    while True:
        above = parents.selectExpr("node AS parent", "parent AS above")
        jumped = parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        jumped, seen = scratch.write(jumped, "jumps", moved=F.count_if("moved"))
        scratch.drop(parents)
        parents = jumped
        if not seen["moved"]:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Self-links and repeated or reversed edges are allowed; null ends are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(edges.sparkSession)
    count = {"n": F.count(F.lit(1))}
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ends, seen = scratch.write(ends.distinct(), "edges", n=F.count_if(F.col("a") > F.col("b")))
    lone = ends.where("a = b").selectExpr("a AS node", "b AS component")
    left, found = ends.where("a > b"), None
    while seen["n"]:
        roots = _to_roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), scratch).select("node", "parent")
        for end in ("a", "b"):
            at = roots.select(F.col("node").alias(end), F.col("parent").alias("root"))
            left = left.join(at, end, "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
        left = left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        left, seen = scratch.write(left, "root-edges", **count)
        now = roots.selectExpr("node", "parent AS component")
        if found is not None:
            on = roots.selectExpr("node AS component", "parent AS root")
            now = found.join(on, "component", "left").select("node", F.coalesce("root", "component").alias("component")).union(now)
        found = now
    if found is None:
        return lone
    found = scratch.write(found, "roots")
    tops = found.select("component").distinct().selectExpr("component AS node", "component")
    return found.union(tops).union(lone.join(found, "node", "left_anti")).distinct()
