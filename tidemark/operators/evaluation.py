"""Summaries of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import freshness_claims


def summarise(generations: DataFrame) -> DataFrame:
    """One row per model. ``generations``: model, category, accepted, attempts, n_reached, n_leaked, n_digits."""
    return generations.groupBy("model").agg(
        F.count(F.lit(1)).alias("generations"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("n_reached") > 0).alias("reached"),
        F.count_if(F.col("n_leaked") > 0).alias("leaked"),
        F.count_if((F.col("category") == "control") & ~F.col("accepted")).alias("control_failures"),
        F.count_if(F.col("n_digits") > 0).alias("digits"),
        F.coalesce(F.avg(F.when(F.col("accepted"), F.col("attempts"))), F.lit(0.0)).alias("mean_attempts"),
        F.count_if(~F.col("accepted")).alias("no_dashboard"),
    )


def tally(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value)


def freshness_rate(texts: DataFrame) -> DataFrame:
    """(model, generations, asserting): runs with a text that claims to be current. ``texts``: model, run_id, text."""
    runs = texts.groupBy("model", "run_id").agg(F.max(F.size(freshness_claims(F.col("text"))) > 0).alias("asserts"))
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("generations"), F.count_if("asserts").alias("asserting"))
