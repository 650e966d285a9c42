"""Every registered core query against its SQL in DuckDB, on the smallest tables; streaming; and the entry points."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark import calculation_queries, document_queries  # noqa: F401  they register their queries
from tidemark import queries as core
from tidemark.streaming import readings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@needs_data
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(core.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=key)
    ours = sorted((tuple(plain(x) for x in row) for row in df.select(*columns).collect()), key=key)
    assert ours == theirs


@needs_data
def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(core.QUERIES) <= set(entry.queries()) and set(core.SQL) <= set(entry.oracle_sql())


@needs_data
def test_plans_push_down(spark):
    plan = core.source_filter_select(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_shipdate" not in plan and "l_comment" not in plan
    top = core.sort_top_k(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_streaming_windows(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("a", "2024-01-01 01:10:00", 5.0), ("b", "2024-01-01 09:00:00", 7.0)]
    spark.createDataFrame(rows, "site_id string, at string, value double").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site_id string, at timestamp, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", readings.windowed_means(stream), "append"), ("l", readings.latest_readings(stream), "complete"), ("s", readings.sessions(stream), "append")):
        q = df.writeStream.format("memory").queryName(f"stream_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r.mean, r.n) for r in spark.table("stream_w").where("site_id = 'a'").collect()) == [(2.0, 2), (5.0, 1)]
    assert {r.site_id: r.value for r in spark.table("stream_l").collect()} == {"a": 5.0, "b": 7.0}
    assert spark.table("stream_s").where("site_id = 'a'").count() == 2


def test_text_queries_search_whole_documents(spark, tmp_path):
    """What only the texts say, far from their ends, must be found; the made-up sentence alone gives other results."""
    filler = "mumble " * 20_000
    texts = [
        "ft " + filler + "a crest of 12.5 ft, please evacuate; live ozone " + filler,
        filler + "UCR student headcount " + filler + " 1,234% then -7.25 µg/m³ and 12.3",
        None,
    ]
    rows = [(10 * i + 3, t, "en", "s", 100) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: core.QUERIES[name](spark, str(tmp_path)).collect()
    gate = {r.doc_id: (r.n_measurements, r.n_directives) for r in run("freetext_gate_texts")}
    alone = gate[23]
    assert gate[3] == (alone[0] + 1, alone[1] + 1) and gate[13] == (alone[0] + 3, alone[1])
    assert {r.doc_id: r.route for r in run("request_routing_texts")} == {3: "domains:river+air", 13: "ambiguous", 23: "domain:river"}
    assert [(r.generations, r.asserting) for r in run("freshness_claim_rate_texts")] == [(3, 1)]
    numbers = [(r.printed, r.value, r.unit, r.failure) for r in run("number_normalise_texts") if r.doc_id == 13]
    assert numbers[:2] == [("1,234%", 1234.0, "percent", None), ("-7.25 µg/m³", -7.25, "ug_per_m3", None)]


def test_words_end_at_ascii_edges(spark):
    from tidemark.functions import text as tx

    rows = spark.createDataFrame([("éair",), ("airé river",), ("fair",), ("éliveé 3 fté",)], "said string")
    found = rows.select(tx.route_request(F.col("said")).alias("route"), F.size(tx.freshness_claims(F.col("said"))).alias("claims"), F.size(tx.measurements(F.col("said"))).alias("n")).collect()
    assert [tuple(r) for r in found] == [("domain:air", 0, 0), ("domains:river+air", 0, 0), ("unsupported", 0, 0), ("unsupported", 1, 1)]


@needs_data
def test_reachability_walks_whole_relations(spark):
    """Every order and ordered part is reached from the regions, whatever its key."""
    nodes = core.QUERIES["reachability_relations"](spark, SF).select(F.split("node", ":")[0].alias("kind")).groupBy("kind").count()
    found = {r.kind: r["count"] for r in nodes.collect()}
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    known = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    supplied = table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey")
    orders = known.union(supplied).distinct()
    parts = table("lineitem").join(orders.toDF("l_orderkey"), "l_orderkey").select("l_partkey").distinct()
    assert (found["order"], found["part"]) == (orders.count(), parts.count())
    assert found["region"] == table("region").count() and found["customer"] == table("customer").count()
