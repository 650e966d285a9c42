"""Rates as of a time, the order and ids of groups, and digests of outputs."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import field
from tidemark.operators import ordering, rates
from tidemark.operators.rowsets import Rowset


def test_rates_as_of_match_a_search(spark):
    """Ties, null times, rates just at the largest age, slots without rates, an empty relation on either side."""
    rng = random.Random(9)
    known = [(i, "USD", rng.choice(["EUR", "JPY"]), Decimal(rng.randint(1, 999)).scaleb(-2), rng.randrange(0, 20_000, 50)) for i in range(120)]
    known += [(900, "USD", "EUR", Decimal("7.77"), 100), (901, "USD", "EUR", Decimal("8.88"), 100), (902, "USD", "EUR", Decimal("9.99"), None)]
    asked = [(i, "USD", rng.choice(["EUR", "JPY", "GBP"]), rng.randrange(-50, 30_000)) for i in range(300)] + [(998, "USD", "EUR", 100), (999, None, "EUR", 5), (1000, "USD", "EUR", None)]
    at = lambda c: F.timestamp_millis(c).alias
    rate = spark.createDataFrame(known, "evidence_id int, from_currency string, to_currency string, rate decimal(9,2), t bigint").select("evidence_id", "from_currency", "to_currency", "rate", at("t")("observed_at"))
    conversions = spark.createDataFrame(asked, "id int, from_currency string, to_currency string, t bigint").select("id", "from_currency", "to_currency", at("t")("at"))
    for age in (0, 7, 700, 5_000):
        found = {r.id: (r.evidence_id, r.rate) for r in rates.rates_as_of(conversions, rate, age).collect()}
        for i, a, b, t in asked:
            fits = [(o, e, x) for e, p, q, x, o in known if (p, q) == (a, b) and o is not None and t is not None and 0 <= t - o <= age]
            assert found[i] == (max(fits)[1:] if fits else (None, None)), (i, age)
        assert len(found) == len(asked)
    assert rates.rates_as_of(conversions.limit(0), rate).count() == 0
    assert [r.rate for r in rates.rates_as_of(conversions.where("id = 998"), rate.limit(0)).collect()] == [None]


def test_digests_see_rows_and_order_but_no_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 97).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    told = lambda df, *order: tuple(ordering.output_digest(df, list(order)).first())
    one = told(rows, "k", "v")
    assert one[0] == 5000
    assert told(rows.repartition(1), "k", "v") == told(rows.repartition(13, "v"), "k", "v") == told(rows.orderBy(F.rand(1)), F.asc("k"), F.asc("v")) == one
    assert told(rows, F.desc("k"), "v") != one and told(rows.where("v <> 17"), "k", "v") != one and told(rows.withColumn("v", -F.col("v")), "k", "v") != one
    assert told(rows.union(rows.limit(1)), "k", "v")[0] == 5001
    empty = told(rows.limit(0), "k")
    assert empty[0] == 0 and empty[1] != told(rows.limit(1), "k")[1]
    assert told(rows.limit(1025), "v")[0] == 1025 and told(rows.limit(1024), "v")[0] == 1024


def test_groups_are_ordered_by_bytes_and_named_alike(spark):
    rows = spark.createDataFrame([(1, "b", -1, 0), (2, "b", 2, 0), (3, "ab", 2, 4), (4, "b", 2, 4), (5, "b", 2, 0)], "id int, t string, n bigint, t__st int")
    table = lambda df: Rowset(df, {"t": field("t", "text", states=True), "n": field("n", "integer")}, "id")
    found = ordering.ordered_groups(table(rows), "t", "n").orderBy("place").collect()
    # Present texts before stale ones; shorter texts first; a negative number after others.
    assert [(r.t, r.n, r.n_rows, r.first_row) for r in found] == [("b", 2, 2, 2), ("b", -1, 1, 1), ("b", 2, 1, 4), ("ab", 2, 1, 3)]
    again = ordering.ordered_groups(table(rows.repartition(4)), "t", "n").collect()
    assert {r.group_id for r in again} == {r.group_id for r in found} and len({r.group_id for r in found}) == 4 and all(r.group_id[14] == "8" for r in found)
    with pytest.raises(Exception, match="invalid_group_key"):
        ordering.ordered_groups(table(rows.withColumn("n", F.lit(None).cast("bigint"))), "n").collect()
    ranks = ordering.global_rank(spark.range(1000).repartition(7), [F.desc("id")]).collect()
    assert all(r.rank == 999 - r.id for r in ranks)
