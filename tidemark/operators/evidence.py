"""Evidence and reference checks, and the merging rules of composed documents, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unknown_references(uses: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``uses`` whose key ``known`` lacks."""
    return uses.join(known.select(key).distinct(), key, "left_anti")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def stale_lineage(lineage: DataFrame, bundle: DataFrame, evaluated_at, limit_millis: int) -> DataFrame:
    """(metric, evidence_id, problem): lineage that the bundle lacks, that isn't current, or that is too old.

    ``lineage`` has metric and evidence_id, ``bundle`` evidence_id, freshness and observed_at. One join, one scan of each.
    """
    held = lineage.join(bundle.withColumn("_held", F.lit(True)), "evidence_id", "left")
    age = F.unix_micros(F.lit(evaluated_at).cast("timestamp")) - F.unix_micros("observed_at")
    problem = F.when(F.col("_held").isNull(), "missing").when(F.col("freshness") != "current", "not-current").when((age < 0) | (age > limit_millis * 1000), "too-old")
    return held.withColumn("problem", problem).where("problem IS NOT NULL").select("metric", "evidence_id", "problem")


def round_robin(lists: DataFrame, cap: int = 32) -> DataFrame:
    """(group, place, id): ids of several ordered sources taken in turns, repeats dropped, at most ``cap`` of each group.

    ``lists`` has group, source (its order), nth (place within the source) and id.
    """
    first = lists.groupBy("group", "id").agg(F.min(F.struct("nth", "source")).alias("turn"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("turn.nth", "turn.source", "id"))
    return first.withColumn("place", place).where(F.col("place") <= cap).select("group", "place", "id")


def merged_freshness(members: DataFrame) -> DataFrame:
    """(group, status, latest_observation_at): all fresh, all stale, or partial; a time only if every member has one.

    ``members`` has group, status (null for a source that didn't load) and latest_at.
    """
    n = F.count(F.lit(1))
    all_are = lambda what: F.count_if(F.col("status") == what) == n
    status = F.when(all_are("fresh"), "fresh").when(all_are("stale"), "stale").otherwise("partial")
    return members.groupBy("group").agg(status.alias("status"), F.when(F.count("latest_at") == n, F.min("latest_at")).alias("latest_observation_at"))


def merged_statements(statements: Column) -> Column:
    """Of the statement types in an array, the two weakest, in the order observed, calculated, interpreted."""
    kinds = F.array_distinct(statements)
    three = F.size(F.array_intersect(kinds, F.array(*[F.lit(x) for x in ("observed", "calculated", "interpreted")]))) == 3
    ordered = F.filter(F.array(F.lit("observed"), F.lit("calculated"), F.lit("interpreted")), lambda x: F.array_contains(kinds, x))
    return F.when(three, F.array(F.lit("calculated"), F.lit("interpreted"))).otherwise(ordered)


def severity_first(alerts: DataFrame, group: str) -> DataFrame:
    """The most severe alert of each group, of equal ones the first id."""
    weight = F.when(F.col("severity") == "warning", 3).when(F.col("severity") == "attention", 2).otherwise(1)
    order = Window.partitionBy(group).orderBy(weight.desc(), "id")
    return alerts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def uncovered_claims(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims said to be complete that no evidence supports."""
    return claims.where("state = 'complete'").join(links.select("claim_id").distinct(), "claim_id", "left_anti")
