"""Registered queries over the driver's tables, one or more for each operator, beside the SQL that states their results."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.functions import text as tx
from tidemark.functions import values as v
from tidemark.functions.values import field
from tidemark.operators import evaluation, evidence, history, reachability, rowsets, stations, verification
from tidemark.operators.rowsets import Key, Rowset
from tidemark.plans import dashboards
from tidemark.plans.contracts import ContractSet, MetricContract, measure
from tidemark.registry import QUERIES, SQL, query
from tidemark.session import with_checkpoints
from tidemark.sources.tables import canonical_json, read_table

# --- the tables as rowsets -----------------------------------------------------------------------------------------


def lineitem(spark: SparkSession, sf_dir: str) -> Rowset:
    df = read_table(spark, sf_dir, "lineitem")
    money = {c: field(c, "decimal", 2) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    whole = {c: field(c, "integer") for c in ("l_orderkey", "l_linenumber")}
    return Rowset(df, money | whole | {c: field(c, "text") for c in ("l_returnflag", "l_linestatus")}, "l_orderkey")


def orders(spark: SparkSession, sf_dir: str, currency: str | None = None) -> Rowset:
    df = read_table(spark, sf_dir, "orders")
    return Rowset(df, {"o_orderkey": field("o_orderkey", "integer"), "o_custkey": field("o_custkey", "integer"), "o_totalprice": field("o_totalprice", "decimal", 2, currency=currency), "o_orderstatus": field("o_orderstatus", "text"), "o_orderpriority": field("o_orderpriority", "text")}, "o_orderkey")


def events(spark: SparkSession, sf_dir: str, states: bool = True) -> Rowset:
    """Events, with states drawn from their ids: of ten, one each null, missing, unavailable and stale."""
    df = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    code = F.expr("CASE event_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END")
    if states:
        df = df.withColumn("value__st", code).withColumn("big", F.col("value") > 50).withColumn("big__st", code)
        df = df.withColumn("even", F.col("user_id") % 2 == 0).withColumn("even__st", F.expr("CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END"))
    fields = {"event_id": field("event_id", "integer"), "user_id": field("user_id", "integer"), "event_type": field("event_type", "text"), "ts": field("ts", "timestamp"), "value": field("value", "decimal", 2, states)}
    if states:
        fields |= {"big": field("big", "boolean", states=True), "even": field("even", "boolean", states=True)}
    return Rowset(df, fields, "event_id")


def _plain(rows: Rowset, **kinds: str) -> DataFrame:
    """Columns cast for comparison; decimals as text keep every digit."""
    return rows.df.select(*[F.col(c).cast(kinds.get(c, dict(rows.df.dtypes)[c])).alias(c) for c in rows.df.columns])


# SQL templates: a whole number's quotient rounded half to even, and event states.
def HE(n: str, d: str) -> str:
    n, d = f"({n})", f"({d})"
    rest, down = f"({n} % {d})", f"({n} // {d})"
    return f"({down} + CASE WHEN 2 * abs{rest} > abs{d} OR (2 * abs{rest} = abs{d} AND {down} % 2 <> 0) THEN CASE WHEN ({n} < 0) = ({d} < 0) THEN 1 ELSE -1 END ELSE 0 END)"


def C(column: str, scale: int = 2) -> str:
    """A column's whole coefficient in SQL."""
    return f"(({column})::DECIMAL(18,{scale}) * {10**scale})::HUGEINT"


ST = "CASE event_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END"
ST7 = "CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END"

# --- scan, projection, predicates --------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS price FROM lineitem WHERE l_discount::DECIMAL(12,2) >= 0.05 AND l_returnflag = 'R'")
def source_filter_select(spark, sf_dir):
    t = lineitem(spark, sf_dir)
    kept = t.filter(v.and_(v.greater_equal(t["l_discount"], v.literal("0.05", "decimal")), v.equal(t["l_returnflag"], v.literal("R", "text"))))
    return _plain(kept.select(line=kept["l_linenumber"], price=kept["l_extendedprice"]), price="double").withColumnRenamed("line", "l_linenumber")


@query(f"""SELECT event_id, CASE WHEN st IN (0, 4) THEN val > 50 END AS is_more, st AS is_more__st FROM (SELECT event_id, value AS val, {ST} AS st FROM events)""")
def compare_with_states(spark, sf_dir):
    t = events(spark, sf_dir)
    return t.select(is_more=v.greater(t["value"], v.literal("50", "decimal"))).df


_COMPARISONS = {"equal": "=", "not_equal": "<>", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">="}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"l_quantity {s} l_linenumber * 5 AS c_{n}" for n, s in _COMPARISONS.items()) + " FROM lineitem")
def comparisons(spark, sf_dir):
    t = lineitem(spark, sf_dir)
    five = v.multiply(t["l_linenumber"], v.literal(5, "integer"), 2)
    return t.select(l_linenumber=t["l_linenumber"], **{f"c_{n}": getattr(v, n)(t["l_quantity"], five) for n in _COMPARISONS}).df


@query(f"""
SELECT event_id, a AND b AS both, CASE WHEN (NOT a AND sa = 0) OR (NOT b AND sb = 0) THEN 0 WHEN NOT a OR NOT b THEN 4 WHEN sa = 3 OR sb = 3 THEN 3 WHEN sa = 2 OR sb = 2 THEN 2 WHEN sa = 1 OR sb = 1 THEN 1 WHEN sa = 4 OR sb = 4 THEN 4 ELSE 0 END AS both__st,
       a OR b AS any_of, CASE WHEN (a AND sa = 0) OR (b AND sb = 0) THEN 0 WHEN a OR b THEN 4 WHEN sa = 3 OR sb = 3 THEN 3 WHEN sa = 2 OR sb = 2 THEN 2 WHEN sa = 1 OR sb = 1 THEN 1 WHEN sa = 4 OR sb = 4 THEN 4 ELSE 0 END AS any_of__st,
       NOT a AS neither, sa AS neither__st
FROM (SELECT event_id, CASE WHEN sa IN (0, 4) THEN value > 50 END AS a, sa, CASE WHEN sb IN (0, 4) THEN user_id % 2 = 0 END AS b, sb
      FROM (SELECT *, {ST} AS sa, {ST7} AS sb FROM events))""")
def boolean_states(spark, sf_dir):
    t = events(spark, sf_dir)
    return t.select(both=v.and_(t["big"], t["even"]), any_of=v.or_(t["big"], t["even"]), neither=v.not_(t["big"])).df


@query(f"""
SELECT event_id, CASE WHEN sb NOT IN (0, 4) THEN NULL WHEN c THEN CASE WHEN sa IN (0, 4) THEN value END ELSE 7 END::DOUBLE AS chosen,
       CASE WHEN sb NOT IN (0, 4) THEN sb ELSE CASE WHEN sb = 4 AND (CASE WHEN c THEN sa ELSE 0 END) = 0 THEN 4 ELSE CASE WHEN c THEN sa ELSE 0 END END END AS chosen__st
FROM (SELECT event_id, value, user_id % 2 = 0 AS c, {ST} AS sa, {ST7} AS sb FROM events)""")
def if_then_else_states(spark, sf_dir):
    t = events(spark, sf_dir)
    return _plain(t.select(chosen=v.if_then_else(t["even"], t["value"], v.literal("7", "decimal"))), chosen="double")


@query(f"""
SELECT event_id, CASE WHEN sa IN (0, 4) THEN value WHEN sa = 3 THEN NULL ELSE -1 END::DOUBLE AS filled, CASE WHEN sa IN (3, 4) THEN sa ELSE 0 END AS filled__st
FROM (SELECT event_id, value, {ST} AS sa FROM events)""")
def coalesce_states(spark, sf_dir):
    t = events(spark, sf_dir)
    return _plain(t.select(filled=v.coalesce(t["value"], v.literal("-1", "decimal"))), filled="double")


@query(f"""
SELECT event_id, CASE WHEN sa IN (0, 4) AND sb IN (0, 4) THEN (value::DECIMAL(12,2) + user_id)::DOUBLE END AS total,
       CASE WHEN sa = 3 OR sb = 3 THEN 3 WHEN sa = 2 OR sb = 2 THEN 2 WHEN sa = 1 OR sb = 1 THEN 1 WHEN sa = 4 OR sb = 4 THEN 4 ELSE 0 END AS total__st
FROM (SELECT *, {ST} AS sa, {ST7} AS sb FROM events)""")
def add_states(spark, sf_dir):
    from dataclasses import replace

    t = events(spark, sf_dir)
    code = F.expr(ST7)
    user = replace(t["user_id"], payload=F.when(code.isin(0, 4), F.col("user_id")), state=code)
    return _plain(t.select(total=v.add(t["value"], user, 2)), total="double")


# --- exact arithmetic --------------------------------------------------------------------------------------------


@query(f"""
SELECT l_orderkey, l_linenumber, ((l_extendedprice::DECIMAL(12,2) + l_tax::DECIMAL(12,2)))::DOUBLE AS added, {HE(f"{C('l_extendedprice')} - {C('l_tax')}", "10")}::BIGINT AS less_tenths,
       {HE(f"{C('l_extendedprice')} * {C('l_discount')}", "100")}::BIGINT AS off_cents, abs(l_tax::DECIMAL(12,2) - l_discount::DECIMAL(12,2))::DOUBLE AS apart
FROM lineitem""")
def arithmetic_add_multiply(spark, sf_dir):
    t = lineitem(spark, sf_dir)
    price, tax, off = t["l_extendedprice"], t["l_tax"], t["l_discount"]
    rows = t.select(l_linenumber=t["l_linenumber"], added=v.add(price, tax, 2), less=v.subtract(price, tax, 1), off=v.multiply(price, off, 2), apart=v.absolute(v.subtract(tax, off, 2)))
    whole = lambda c, s: (F.col(c) * 10**s).cast("bigint")
    return rows.df.select("l_orderkey", "l_linenumber", F.col("added").cast("double").alias("added"), whole("less", 1).alias("less_tenths"), whole("off", 2).alias("off_cents"), F.col("apart").cast("double").alias("apart"))


@query(f"""SELECT l_orderkey, l_linenumber, {HE(f"{C('l_extendedprice')} * 1000000", C('l_quantity'))}::VARCHAR AS millionths FROM lineitem""")
def arithmetic_divide_half_even(spark, sf_dir):
    t = lineitem(spark, sf_dir)
    rows = t.select(l_linenumber=t["l_linenumber"], q=v.divide(t["l_extendedprice"], t["l_quantity"], 6))
    return rows.df.select("l_orderkey", "l_linenumber", (F.col("q") * F.lit("1000000").cast("decimal(7,0)")).cast("decimal(38,0)").cast("string").alias("millionths"))


@query(f"""SELECT o_orderkey, {HE(C('o_totalprice'), '100')}::BIGINT AS units, least(greatest(o_totalprice::DECIMAL(12,2), 1000), 200000)::DOUBLE AS held FROM orders""")
def round_and_clamp(spark, sf_dir):
    t = orders(spark, sf_dir)
    rows = t.select(units=v.round_to(t["o_totalprice"], 0), held=v.clamp(t["o_totalprice"], 1000, 200000))
    return _plain(rows, units="bigint", held="double")


# --- grouping ----------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) AS n_prices, sum(l_extendedprice::DECIMAL(12,2))::VARCHAR AS total FROM lineitem GROUP BY ALL""")
def group_count_sum(spark, sf_dir):
    g = lineitem(spark, sf_dir).group("l_returnflag", "l_linestatus")
    return _plain(g.aggregate(n=g.count_rows(), n_prices=g.count_present("l_extendedprice"), total=g.sum("l_extendedprice")), total="string")


@query("""SELECT l_linestatus, min(l_extendedprice::DECIMAL(12,2))::DOUBLE AS low, max(l_extendedprice::DECIMAL(12,2))::DOUBLE AS high, max(l_linenumber)::BIGINT AS last_line FROM lineitem GROUP BY ALL""")
def group_min_max(spark, sf_dir):
    g = lineitem(spark, sf_dir).group("l_linestatus")
    return _plain(g.aggregate(low=g.min("l_extendedprice"), high=g.max("l_extendedprice"), last_line=g.max("l_linenumber")), low="double", high="double")


@query(f"""SELECT l_returnflag, {HE(f"sum({C('l_extendedprice')}) * 10000000000000000", "count(*)")}::VARCHAR AS mean_e18 FROM lineitem GROUP BY ALL""")
def group_mean_exact(spark, sf_dir):
    g = lineitem(spark, sf_dir).group("l_returnflag")
    rows = g.aggregate(mean=g.mean("l_extendedprice", 18))
    return rows.df.select("l_returnflag", F.replace(F.col("mean").cast("string"), F.lit("."), F.lit("")).alias("mean_e18"))


@query(f"""
SELECT l_returnflag, (total // (n * 100) * 100000000000000 + {HE("total % (n * 100) * 100000000000000", "n * 100")})::VARCHAR AS mean_e14
FROM (SELECT l_returnflag, sum({C('l_extendedprice')}) * 10000000000000 AS total, count(*)::HUGEINT AS n FROM lineitem GROUP BY l_returnflag)""")
def mean_wide(spark, sf_dir):
    """Means of numbers near 10**18 with two decimals, to 14 decimals: 33 digits."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice").cast("decimal(12,2)").cast("decimal(24,2)") * F.lit(10**13).cast("decimal(14,0)")).cast("decimal(38,2)").alias("price"))
    g = Rowset(rows, {"l_returnflag": field("l_returnflag", "text"), "price": field("price", "decimal", 2)}, "l_orderkey").group("l_returnflag")
    return g.aggregate(mean=g.mean("price", 14)).df.select("l_returnflag", F.replace(F.col("mean").cast("string"), F.lit("."), F.lit("")).alias("mean_e14"))


@query("""SELECT count(*) AS n, coalesce(sum(o_totalprice::DECIMAL(12,2)), 0)::VARCHAR AS total FROM orders WHERE o_orderkey < 0""")
def group_global_empty(spark, sf_dir):
    t = orders(spark, sf_dir)
    g = t.filter(v.less(t["o_orderkey"], v.literal(0, "integer"))).group()
    rows = g.aggregate(n=g.count_rows(), total=g.sum("o_totalprice"))
    return rows.df.select("n", F.col("total").cast("string").alias("total"))


@query(f"""
SELECT user_id, CASE WHEN bad = 0 THEN n END AS n, CASE WHEN bad = 0 THEN total END AS total, CASE WHEN bad = 1 THEN 3 WHEN old = 1 THEN 4 ELSE 0 END AS total__st, CASE WHEN bad = 1 THEN 3 WHEN old = 1 THEN 4 ELSE 0 END AS n__st
FROM (SELECT user_id, count(*) FILTER (WHERE st IN (0, 4)) AS n, coalesce(sum(value::DECIMAL(12,2)) FILTER (WHERE st IN (0, 4)), 0)::DOUBLE AS total, max(CASE WHEN st = 3 THEN 1 ELSE 0 END) AS bad, max(CASE WHEN st = 4 THEN 1 ELSE 0 END) AS old
      FROM (SELECT *, {ST} AS st FROM events) GROUP BY user_id)""")
def group_with_states(spark, sf_dir):
    g = events(spark, sf_dir).group("user_id")
    return _plain(g.aggregate(n=g.count_present("value"), total=g.sum("value")), total="double")


# --- order and windows -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders ORDER BY o_totalprice::DECIMAL(12,2) DESC, o_orderkey LIMIT 100""")
def sort_top_k(spark, sf_dir):
    t = orders(spark, sf_dir)
    return t.sort(Key("o_totalprice", descending=True)).top_k(100).df.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))


@query(f"""
SELECT event_id FROM (SELECT event_id, value, {ST} AS st FROM events)
ORDER BY CASE WHEN st IN (0, 4) THEN 1 ELSE 0 END, CASE st WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END, CASE WHEN st = 4 THEN 1 ELSE 0 END, CASE WHEN st IN (0, 4) THEN value::DECIMAL(12,2) END DESC, event_id LIMIT 1000""")
def sort_states_top_k(spark, sf_dir):
    return events(spark, sf_dir).sort(Key("value", descending=True, absent_first=True)).top_k(1000).df.select("event_id")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice::DECIMAL(12,2) DESC, o_orderkey) AS place FROM orders""")
def rank_in_partition(spark, sf_dir):
    t = orders(spark, sf_dir)
    return t.select(place=t.rank(["o_orderpriority"], [Key("o_totalprice", descending=True)])).df


_BY_USER = (["user_id"], [Key("ts")])


@query(f"""
SELECT event_id, CASE WHEN lag(event_id) OVER w IS NULL THEN 2 WHEN lag(st) OVER w IN (0, 4) THEN lag(st) OVER w ELSE lag(st) OVER w END AS before__st, CASE WHEN lag(st) OVER w IN (0, 4) THEN lag(value) OVER w END::DOUBLE AS before
FROM (SELECT *, {ST} AS st FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_states(spark, sf_dir):
    t = events(spark, sf_dir)
    return _plain(t.select(before=t.lag("value", *_BY_USER)), before="double")


@query("""SELECT event_id, (value::DECIMAL(12,2) - lag(value::DECIMAL(12,2)) OVER w)::DOUBLE AS moved, CASE WHEN lag(event_id) OVER w IS NULL THEN 2 ELSE 0 END AS moved__st
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def delta(spark, sf_dir):
    t = events(spark, sf_dir, states=False)
    return _plain(t.select(moved=t.delta("value", *_BY_USER)), moved="double")


@query(f"""SELECT event_id, CASE WHEN b IS NULL THEN NULL ELSE {HE("(c - b) * 100 * 100", "b")} END::BIGINT AS pct_hundredths
FROM (SELECT event_id, {C('value')} + 100 AS c, lag({C('value')} + 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)""")
def percentage_change(spark, sf_dir):
    t = events(spark, sf_dir, states=False)
    t = Rowset(t.df.withColumn("raised", F.col("value").cast("decimal(12,2)") + 1), t.fields | {"raised": field("raised", "decimal", 2)}, "event_id")
    return t.select(pct=t.percentage_change("raised", *_BY_USER)).df.select("event_id", (F.col("pct") * 100).cast("bigint").alias("pct_hundredths"))


@query(f"""
SELECT event_id, CASE WHEN bad = 0 THEN total END AS total, CASE WHEN bad = 1 THEN 3 WHEN old = 1 THEN 4 ELSE 0 END AS total__st
FROM (SELECT event_id, coalesce(sum(CASE WHEN st IN (0, 4) THEN value::DECIMAL(12,2) END) OVER w, 0)::DOUBLE AS total, max(CASE WHEN st = 3 THEN 1 ELSE 0 END) OVER w AS bad, max(CASE WHEN st = 4 THEN 1 ELSE 0 END) OVER w AS old
      FROM (SELECT *, {ST} AS st FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING))""")
def window_sum_rows(spark, sf_dir):
    t = events(spark, sf_dir)
    return _plain(t.select(total=t.window_sum("value", *_BY_USER, 3, 1)), total="double")


@query(f"""SELECT event_id, {HE("s", "n")}::BIGINT AS mean_cents FROM (SELECT event_id, sum({C('value')}) OVER w AS s, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""")
def window_mean_rows(spark, sf_dir):
    t = events(spark, sf_dir, states=False)
    return t.select(mean=t.window_mean("value", *_BY_USER, 6, scale=2)).df.select("event_id", (F.col("mean") * 100).cast("bigint").alias("mean_cents"))


# --- units, currency, freshness ----------------------------------------------------------------------------------


@query(f"""SELECT p_partkey, {HE("p_size::HUGEINT * 381 * 10000", "1250")}::BIGINT AS metres_e4, {HE("p_size::HUGEINT * 127 * 100", "5000 * 100")}::BIGINT AS half_metres FROM part""")
def unit_convert_length(spark, sf_dir):
    df = read_table(spark, sf_dir, "part")
    t = Rowset(df, {"feet": field("p_size", "integer", unit="[ft_i]"), "inches": field("p_size", "integer", unit="[in_i]")}, "p_partkey")
    rows = t.select(m=v.unit_convert(t["feet"], "[ft_i]", "m", 4), h=v.unit_convert(t["inches"], "[in_i]", "m", 0))
    return rows.df.select("p_partkey", (F.col("m") * 10000).cast("bigint").alias("metres_e4"), F.col("h").cast("bigint").alias("half_metres"))


@query(f"""SELECT p_partkey, {HE("(p_size::HUGEINT * 100 + 45967 - 45967 - 3200) * 5 * 10000", "9 * 100")}::BIGINT AS cel_e4 FROM part""")
def unit_convert_affine(spark, sf_dir):
    df = read_table(spark, sf_dir, "part")
    t = Rowset(df, {"f": field("p_size", "integer", unit="[degF]")}, "p_partkey")
    return t.select(c=v.unit_convert(t["f"], "[degF]", "Cel", 4)).df.select("p_partkey", (F.col("c") * 10000).cast("bigint").alias("cel_e4"))


@query(f"""SELECT o_orderkey, {HE(f"{C('o_totalprice')} * 925", "1000")}::BIGINT AS eur_cents, {HE(f"{C('o_totalprice')} * 15", "1000")}::BIGINT AS jpy FROM orders""")
def currency_convert(spark, sf_dir):
    t = orders(spark, sf_dir, currency="USD")
    rate = v.check_rate({"from": "USD", "to": "EUR", "rate": "0.925", "observed_millis": 0}, "USD", "EUR", 86_400_000)
    rows = t.select(eur=v.currency_convert(t["o_totalprice"], "USD", "EUR", rate), jpy=v.currency_convert(t["o_totalprice"], "USD", "JPY", Decimal("1.5")))
    return rows.df.select("o_orderkey", (F.col("eur") * 100).cast("bigint").alias("eur_cents"), F.col("jpy").cast("bigint").alias("jpy"))


_PINNED = 1_704_931_200_000_000  # 2024-01-11T00:00:00Z


@query(f"""SELECT event_id, CASE WHEN {_PINNED} - epoch_us(ts) > 7200000000 THEN 'stale' ELSE 'current' END AS told FROM events""")
def classify_freshness(spark, sf_dir):
    t = events(spark, sf_dir, states=False)
    return t.select(told=v.classify_state(t["ts"], 7_200_000, _PINNED)).df


@query(f"""SELECT CASE WHEN {_PINNED} - max(epoch_us(ts)) > 7200000000 THEN 'stale' ELSE 'current' END AS told FROM events""")
def freshness_of_latest(spark, sf_dir):
    t = events(spark, sf_dir, states=False)
    g = t.group()
    rows = g.aggregate(latest=g.max("ts"))
    return rows.df.select(v.classify_state(field("latest", "timestamp"), 7_200_000, _PINNED).payload.alias("told"))


@query("""SELECT o_orderpriority, sum(o_totalprice::DECIMAL(12,2))::VARCHAR AS total, sum(o_totalprice::DECIMAL(12,2)) >= 1000000 AS meets_threshold, sum(o_totalprice::DECIMAL(12,2)) >= 300000000 AS meets_target FROM orders GROUP BY ALL""")
def contract_revenue(spark, sf_dir):
    contract = MetricContract("revenue", "o_totalprice", "sum", "currency", "higher_is_better", "1000000", "300000000", currency="USD")
    found = measure(orders(spark, sf_dir, currency="USD"), contract, "o_orderpriority")
    return found.df.select("o_orderpriority", F.col("value").cast("string").alias("total"), "meets_threshold", "meets_target")


@query(f"""SELECT l_returnflag, {HE(f"sum({C('l_tax')}) * 100 * 1000000", f"sum({C('l_discount')})")}::VARCHAR AS share_e6, sum({C('l_tax')}) * 100 >= 79 * sum({C('l_discount')}) AS meets_threshold, sum({C('l_tax')}) * 100 <= 81 * sum({C('l_discount')}) AS meets_target FROM lineitem GROUP BY ALL""")
def contract_ratio(spark, sf_dir):
    contract = MetricContract("share", "l_tax", "ratio", "percentage", "target_band", "79", "81", unit="%", denominator="l_discount", scale=6)
    found = measure(lineitem(spark, sf_dir), contract, "l_returnflag")
    return found.df.select("l_returnflag", F.replace(F.col("value").cast("string"), F.lit("."), F.lit("")).alias("share_e6"), "meets_threshold", "meets_target")


@query(f"""SELECT o_orderpriority, {HE(f"sum({C('o_totalprice')}) * 925", "1000")}::VARCHAR AS eur_cents, {HE(f"sum({C('o_totalprice')}) * 925", "1000")} >= 68500000000 AS meets_threshold FROM orders GROUP BY ALL""")
def contract_in_euros(spark, sf_dir):
    """A sum of dollars under a contract in euros."""
    contract = MetricContract("revenue", "o_totalprice", "sum", "currency", "higher_is_better", "685000000", "700000000", currency="EUR")
    found = measure(orders(spark, sf_dir, currency="USD"), contract, "o_orderpriority", conversion=Decimal("0.925"))
    return found.df.select("o_orderpriority", F.replace(F.col("value").cast("string"), F.lit("."), F.lit("")).alias("eur_cents"), "meets_threshold")


@query("SELECT p_brand, sum(p_size) * 3048 AS metres_e4, sum(p_size) * 3048 <= 4000000 AS meets_target FROM part GROUP BY ALL")
def contract_in_metres(spark, sf_dir):
    """A sum of feet under a contract in metres."""
    contract = MetricContract("length", "size", "sum", "decimal", "target_band", "0", "400", unit="m")
    rows = Rowset(read_table(spark, sf_dir, "part"), {"size": field("p_size", "integer", unit="[ft_i]"), "p_brand": field("p_brand", "text")}, "p_partkey")
    found = measure(rows, contract, "p_brand", conversion="unit")
    return found.df.select("p_brand", (F.col("value").cast("decimal(38,4)") * 10_000).cast("bigint").alias("metres_e4"), "meets_target")


# --- stations ----------------------------------------------------------------------------------------------------

_AS_OF = "2024-01-20 12:00:00"
_SIDES = {"view": "primary", "click": "secondary"}


def _observations(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events").where(F.col("event_type").isin(*_SIDES) & (F.col("ts") <= F.lit(_AS_OF).cast("timestamp_ntz")))
    slot = F.when(F.col("event_type") == "view", "primary").otherwise("secondary")
    return e.select((F.col("user_id") % 5).cast("string").alias("site_id"), slot.alias("slot"), F.col("ts").cast("timestamp").alias("at"), "value", F.col("event_id").alias("ordinal"))


def _stations(spark, sf_dir) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("site_id"), F.col("n_name").alias("name"), F.initcap("n_name").alias("group"), F.lit("Level").alias("primary_label"), F.lit("Flow").alias("secondary_label"), F.lit("ft").alias("primary_unit"), F.lit("ft3/s").alias("secondary_unit"))


def _metrics(spark, sf_dir) -> DataFrame:
    return stations.station_metrics(_stations(spark, sf_dir), _observations(spark, sf_dir), _AS_OF)


_OBS = f"""obs AS (SELECT (user_id % 5)::VARCHAR AS site_id, CASE event_type WHEN 'view' THEN 'primary' ELSE 'secondary' END AS slot, ts AS seen, value, event_id AS ordinal FROM events WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '{_AS_OF}'),
last AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY site_id, slot ORDER BY seen DESC, ordinal DESC) = 1)"""
_CHANGE = ", ".join(f"(SELECT round((l.value - arg_max(o.value, (o.seen, o.ordinal)))::DECIMAL(12,2), 2)::DOUBLE FROM obs o WHERE o.slot = 'primary' AND o.site_id = l.site_id AND o.seen <= l.seen - INTERVAL {h} HOUR AND o.seen >= l.seen - INTERVAL {h} HOUR - INTERVAL 90 MINUTE) AS change_{h}h" for h in (1, 6, 24))
_METRICS = f"""{_OBS},
ch AS (SELECT site_id, {_CHANGE} FROM last l WHERE slot = 'primary'),
base AS (SELECT n_nationkey::VARCHAR AS site_id, n_name AS name, upper(n_name[1]) || lower(n_name[2:]) AS "group", p.value AS latest_primary, s.value AS latest_secondary, greatest(p.seen, s.seen) AS latest_at, change_1h, change_6h, change_24h,
  CASE WHEN p.seen IS NULL THEN 'missing' WHEN TIMESTAMP '{_AS_OF}' - p.seen > INTERVAL 2 HOUR THEN 'stale' ELSE 'fresh' END AS pf,
  CASE WHEN s.seen IS NULL THEN 'missing' WHEN TIMESTAMP '{_AS_OF}' - s.seen > INTERVAL 2 HOUR THEN 'stale' ELSE 'fresh' END AS sf
  FROM nation LEFT JOIN last p ON p.site_id = n_nationkey::VARCHAR AND p.slot = 'primary' LEFT JOIN last s ON s.site_id = n_nationkey::VARCHAR AND s.slot = 'secondary' LEFT JOIN ch ON ch.site_id = n_nationkey::VARCHAR),
metrics AS (SELECT *, CASE WHEN pf <> 'fresh' OR coalesce(change_1h, change_6h) IS NULL THEN 'unknown' WHEN coalesce(change_1h, change_6h) > 0.05 THEN 'rising' WHEN coalesce(change_1h, change_6h) < -0.05 THEN 'falling' ELSE 'steady' END AS direction,
  CASE WHEN 'missing' IN (pf, sf) THEN 'missing' WHEN 'stale' IN (pf, sf) THEN 'stale' ELSE 'fresh' END AS freshness,
  (pf <> 'fresh')::INT + (sf <> 'fresh')::INT AS n_issues FROM base)"""


@query(f"WITH {_OBS} SELECT site_id, slot, epoch_us(seen) AS at_us, value FROM last")
def station_latest(spark, sf_dir):
    return stations.latest(_observations(spark, sf_dir)).select("site_id", "slot", F.unix_micros("at").alias("at_us"), "value")


@query(f"WITH {_OBS} SELECT site_id, {_CHANGE} FROM last l WHERE slot = 'primary'")
def station_asof_change(spark, sf_dir):
    return stations.changes(_observations(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT site_id, latest_primary, latest_secondary, direction, freshness, pf AS primary_freshness, sf AS secondary_freshness, n_issues FROM metrics")
def station_direction_freshness(spark, sf_dir):
    return _metrics(spark, sf_dir).select("site_id", "latest_primary", "latest_secondary", "direction", "freshness", "primary_freshness", "secondary_freshness", F.size("issues").alias("n_issues"))


_AIR_METRICS = _METRICS.replace("> 0.05", "> 2.0").replace("< -0.05", "< -2.0")


@query(f"WITH {_AIR_METRICS} SELECT site_id, direction, change_1h FROM metrics WHERE pf = 'fresh'")
def station_direction_air(spark, sf_dir):
    """Directions by the air policy's tolerance, of stations with a fresh reading."""
    m = stations.station_metrics(_stations(spark, sf_dir), _observations(spark, sf_dir), _AS_OF, stations.AIR)
    return m.where("primary_freshness = 'fresh'").select("site_id", "direction", "change_1h")


@query(f"""WITH {_METRICS} SELECT 'no-alerts' AS id, 'info' AS severity, 'No configured thresholds are active' AS title, (SELECT count(*) FROM metrics WHERE freshness = 'fresh' AND n_issues = 0)::BIGINT AS n_sound
WHERE NOT EXISTS (SELECT 1 FROM metrics WHERE freshness = 'fresh' AND n_issues = 0 AND latest_primary > 1000000)""")
def station_all_clear(spark, sf_dir):
    """Sound stations and a threshold that none exceeds."""
    m = _metrics(spark, sf_dir).where((F.col("freshness") == "fresh") & (F.size("issues") == 0))
    limits = _stations(spark, sf_dir).select(F.concat(F.lit("above-"), "site_id").alias("id"), F.lit("High level").alias("label"), "site_id", F.lit(1e6).alias("above"))
    n = m.agg(F.count(F.lit(1)).alias("n_sound"))  # one row
    return stations.alerts(m, limits).select("id", "severity", "title").join(F.broadcast(n))


@query(f"WITH {_METRICS} SELECT site_id, change_1h FROM metrics WHERE change_1h > 0.05 AND freshness = 'fresh' AND n_issues = 0")
def station_ranked(spark, sf_dir):
    return stations.ranked(_metrics(spark, sf_dir)).select("site_id", "change_1h")


@query(f"WITH {_METRICS} SELECT direction, count(*) AS n FROM metrics WHERE pf = 'fresh' AND direction IN ('rising', 'falling') GROUP BY ALL UNION ALL SELECT 'check', count(*) FROM metrics WHERE freshness <> 'fresh' OR n_issues > 0")
def station_subsets(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    both = stations.moving(m, "rising").unionByName(stations.moving(m, "falling")).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
    return both.unionByName(stations.stale_or_missing(m).agg(F.lit("check").alias("direction"), F.count(F.lit(1)).alias("n")))


@query(f"""WITH {_METRICS}, issues AS (
  SELECT site_id, "group", freshness, unnest(list_filter([CASE pf WHEN 'missing' THEN 'Level readings are missing' WHEN 'stale' THEN 'Level reading is more than two hours old' END, CASE sf WHEN 'missing' THEN 'Flow readings are missing' WHEN 'stale' THEN 'Flow reading is more than two hours old' END], lambda x: x IS NOT NULL)) AS detail,
         generate_subscripts(list_filter([nullif(pf, 'fresh'), nullif(sf, 'fresh')], lambda x: x IS NOT NULL), 1) - 1 AS nth FROM metrics)
SELECT site_id || '-quality-' || nth AS id, CASE freshness WHEN 'fresh' THEN 'attention' ELSE 'warning' END AS severity, "group" AS title, detail, site_id FROM issues
UNION ALL SELECT 'above-' || site_id, 'attention', 'High level', "group" || ' is ' || regexp_replace(regexp_replace(format('{{:,.2f}}', latest_primary), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ' ft, above the user threshold of 50 ft.', site_id FROM metrics WHERE pf = 'fresh' AND latest_primary > 50""")
def station_alerts(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    limits = _stations(spark, sf_dir).select(F.concat(F.lit("above-"), "site_id").alias("id"), F.lit("High level").alias("label"), "site_id", F.lit(50.0).alias("above"))
    return stations.alerts(m, limits)


@query(f"WITH {_METRICS} SELECT epoch_us(max(latest_at)) AS latest_us FROM metrics")
def station_latest_observation(spark, sf_dir):
    return stations.latest_observation(_metrics(spark, sf_dir)).select(F.unix_micros("latest_observation_at").alias("latest_us"))


@query(f"""WITH {_METRICS} SELECT 'station-' || site_id AS id, 'observed' AS kind, "group" || ' ' || site_id AS label, epoch_us(latest_at) AS observed_us, 'Level and Flow observations for ' || name || '.' AS detail, 'high' AS confidence FROM metrics
UNION ALL SELECT 'calculations', 'calculated', 'Calculations', NULL, 'Changes over 1, 6 and 24 hours, directions and rankings.', 'high' UNION ALL SELECT 'note-' || r_regionkey, 'interpreted', r_name, NULL, 'As noted.', 'medium' FROM region""")
def station_evidence(spark, sf_dir):
    none = F.lit(None)
    notes = read_table(spark, sf_dir, "region").select(
        F.concat(F.lit("note-"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("interpreted").alias("kind"), F.col("r_name").alias("label"), F.lit("Notes").alias("source_name"), none.cast("string").alias("source_url"),
        none.cast("timestamp").alias("observed_at"), F.lit(_AS_OF).cast("timestamp").alias("retrieved_at"), F.lit("As noted.").alias("detail"), F.lit("medium").alias("confidence"),
    )
    found = stations.station_evidence(_metrics(spark, sf_dir), _AS_OF, notes)
    return found.select("id", "kind", "label", F.unix_micros("observed_at").alias("observed_us"), "detail", "confidence")


@query(f"WITH {_OBS} SELECT site_id, ordinal, CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END AS value_scaled FROM obs WHERE slot = 'primary' WINDOW w AS (PARTITION BY site_id)")
def trend_scaling(spark, sf_dir):
    return stations.scaled(_observations(spark, sf_dir).where("slot = 'primary'"), "site_id", "value").select("site_id", "ordinal", "value_scaled")


# --- dashboards --------------------------------------------------------------------------------------------------

_SIGNED = lambda c: rf"""CASE WHEN {c} IS NULL THEN 'Not enough history' ELSE CASE WHEN {c} > 0 THEN '+' ELSE '' END || regexp_replace(regexp_replace(format('{{:,.2f}}', {c}), '(\.\d*?)0+$', '\1'), '\.$', '') || ' ft' END"""
_RANKED = "change_1h > 0.05 AND freshness = 'fresh' AND n_issues = 0"


@query(f"""WITH {_METRICS} SELECT 1 AS place, 'Gauges monitored' AS label, count(*) AS value, NULL AS direction FROM metrics UNION ALL SELECT 2, 'Rising', count(*), 'up' FROM metrics WHERE pf = 'fresh' AND direction = 'rising'
UNION ALL SELECT 3, 'Falling', count(*), 'down' FROM metrics WHERE pf = 'fresh' AND direction = 'falling' UNION ALL SELECT 4, 'Freshness checks', count(*), CASE WHEN count(*) > 0 THEN 'unknown' ELSE 'steady' END FROM metrics WHERE freshness <> 'fresh' OR n_issues > 0""")
def dashboard_headline(spark, sf_dir):
    return dashboards.headline_metrics(_metrics(spark, sf_dir))


@query(f"""WITH {_METRICS}, c AS (SELECT count(*) FILTER (WHERE pf = 'fresh' AND direction = 'rising') AS up, count(*) FILTER (WHERE pf = 'fresh' AND direction = 'falling') AS down, count(*) FILTER (WHERE freshness <> 'fresh' OR n_issues > 0) AS checks FROM metrics),
top AS (SELECT "group" AS name, change_1h FROM metrics WHERE {_RANKED} ORDER BY change_1h DESC, site_id LIMIT 1)
SELECT 0 AS place, up || ' gauge' || CASE up WHEN 1 THEN ' is' ELSE 's are' END || ' rising and ' || down || CASE down WHEN 1 THEN ' is' ELSE ' are' END || ' falling.' AS claim FROM c
UNION ALL SELECT 1, coalesce((SELECT name || ' is the fastest-rising complete gauge over the last hour at ' || {_SIGNED('change_1h')} || '.' FROM top), 'No fresh, complete gauge is rising fast enough to rank over the last hour.')
UNION ALL SELECT 2, CASE WHEN checks > 0 THEN checks || ' gauge' || CASE checks WHEN 1 THEN ' needs' ELSE 's need' END || ' a freshness or completeness check.' ELSE 'All selected gauges are fresh and complete.' END FROM c""")
def dashboard_summary(spark, sf_dir):
    return dashboards.conditions_summary(_metrics(spark, sf_dir))


@query(f"""WITH {_METRICS} SELECT site_id, "group" AS label, '1h ' || {_SIGNED('change_1h')} AS value, '6h ' || {_SIGNED('change_6h')} || ' · 24h ' || {_SIGNED('change_24h')} AS note FROM metrics""")
def dashboard_change_windows(spark, sf_dir):
    return dashboards.change_windows(_metrics(spark, sf_dir))


@query(f"WITH {_OBS}, many AS (SELECT site_id FROM obs WHERE slot = 'primary' GROUP BY 1 HAVING count(*) >= 2) SELECT o.site_id, epoch_us(seen) AS at_us, value FROM obs o JOIN many USING (site_id) JOIN nation ON n_nationkey::VARCHAR = site_id WHERE slot = 'primary'")
def dashboard_trends(spark, sf_dir):
    return dashboards.trends(_metrics(spark, sf_dir), _observations(spark, sf_dir)).select("site_id", F.unix_micros("at").alias("at_us"), "value")


@query("""WITH plans AS (SELECT n_nationkey AS plan_id, CASE WHEN n_nationkey % 5 = 4 THEN ['-1'] ELSE [n_nationkey::VARCHAR, (n_nationkey + 1)::VARCHAR, n_nationkey::VARCHAR, '-1'] END AS sites FROM nation),
s AS (SELECT plan_id, unnest(sites) AS subject, generate_subscripts(sites, 1) - 1 AS i, sites FROM plans)
SELECT plan_id, 'unknown-site' AS finding, 'siteIds[' || i || ']' AS path, subject FROM s WHERE subject = '-1'
UNION ALL SELECT plan_id, 'duplicate-site', 'siteIds[' || i || ']', subject FROM s WHERE subject <> '-1' AND list_position(sites, subject) <= i
UNION ALL SELECT plan_id, 'no-known-sites', 'siteIds', NULL FROM plans WHERE plan_id % 5 = 4
UNION ALL SELECT plan_id, 'duplicate-page', 'pages[1].id', 'a' FROM plans WHERE plan_id % 5 = 0
UNION ALL SELECT plan_id, 'duplicate-section', 'pages[1].sections[0]', 'gauge-map' FROM plans WHERE plan_id % 5 = 1
UNION ALL SELECT plan_id, 'section-needs-sites', 'pages[0].sections[1]', 'gauge-map' FROM plans WHERE plan_id % 5 = 4
UNION ALL SELECT plan_id, 'free-text-measurement', 'pages[1].description', plan_id || ' ft' FROM plans WHERE plan_id % 5 = 2
UNION ALL SELECT plan_id, 'free-text-directive', 'framing', 'avoid the ' || n_name || ' roads' FROM plans JOIN nation ON n_nationkey = plan_id WHERE plan_id % 5 = 3 AND NOT contains(n_name, ' ')""")
def plan_findings(spark, sf_dir):
    """Plans of every nation with a fault of each kind among them."""
    k = F.col("n_nationkey")
    case, key = k % 5, k.cast("string")
    page = lambda i, sections, said: F.struct(F.lit(i).alias("id") if isinstance(i, str) else i.alias("id"), F.lit("Levels").alias("title"), said.alias("description"), sections.alias("sections"))
    kinds = lambda *names: F.array(*[F.lit(x) for x in names])
    second = F.when(case == 1, kinds("gauge-map")).otherwise(kinds("attention"))
    pages = F.array(page("a", kinds("headline-metrics", "gauge-map"), F.lit("Where")), page(F.when(case == 0, "a").otherwise("b"), second, F.when(case == 2, F.concat(F.lit("About "), key, F.lit(" ft"))).otherwise(F.lit("What"))))
    sites = F.when(case == 4, F.array(F.lit("-1"))).otherwise(F.array(key, (k + 1).cast("string"), key, F.lit("-1")))
    framing = F.when((case == 3) & ~F.contains("n_name", F.lit(" ")), F.concat(F.lit("Please avoid the "), "n_name", F.lit(" roads"))).otherwise(F.lit("As asked"))
    plans = read_table(spark, sf_dir, "nation").select(k.alias("plan_id"), F.lit("Levels").alias("title"), F.lit("desk").alias("audience"), framing.alias("framing"), sites.alias("site_ids"), pages.alias("pages"))
    return dashboards.plan_findings(plans, read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("site_id")))


@query(f"""WITH {_METRICS} SELECT site_id, "group" AS label, {_SIGNED('change_1h')} AS value, direction || '; 6h ' || {_SIGNED('change_6h')} AS note FROM metrics WHERE {_RANKED}""")
def dashboard_ranking(spark, sf_dir):
    return dashboards.ranking(_metrics(spark, sf_dir))


@query(f"SELECT site_id, id, severity FROM ({SQL['station_alerts']}) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY CASE severity WHEN 'warning' THEN 3 WHEN 'attention' THEN 2 ELSE 1 END DESC, id) = 1")
def alert_highest(spark, sf_dir):
    return evidence.severity_first(station_alerts(spark, sf_dir), "site_id").select("site_id", "id", "severity")


@query("""SELECT n_nationkey AS plan_id, p AS place, c_custkey::VARCHAR AS site_id FROM (SELECT n_nationkey, generate_subscripts(s, 1) - 1 AS p, unnest(s) AS k FROM (SELECT n_nationkey, [n_nationkey * 7, n_nationkey + 1, -5] AS s FROM nation)) JOIN customer ON c_custkey = k""")
def plan_ordered_sites(spark, sf_dir):
    n = F.col("n_nationkey")
    plans = read_table(spark, sf_dir, "nation").select(n.alias("plan_id"), F.array((n * 7).cast("string"), (n + 1).cast("string"), F.lit("-5")).alias("site_ids"))
    sites = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("site_id"))
    return dashboards.ordered_sites(plans, sites).select("plan_id", "place", "site_id")


@query("""SELECT 0 AS source, 'river-' || r_name AS id, 'summary' AS kind, r_name AS title FROM region UNION ALL SELECT 1, 'air-absent', 'notice', 'Source unavailable' UNION ALL SELECT 2, 'other-' || n_name, 'table', n_name FROM nation""")
def dashboard_compose(spark, sf_dir):
    part = lambda t, c, kind: read_table(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(kind).alias("kind"), F.col(c).alias("title"))
    return dashboards.compose([("river", part("region", "r_name", "summary")), ("air", None), ("other", part("nation", "n_name", "table"))])


# --- evidence and merging ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def evidence_antijoin(spark, sf_dir):
    uses = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return evidence.unknown_references(uses, read_table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return evidence.duplicates(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT c_mktsegment AS metric, o_orderkey AS evidence_id, CASE WHEN e.event_id IS NULL THEN 'missing' WHEN event_type <> 'view' THEN 'not-current' ELSE 'too-old' END AS problem
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN events e ON e.event_id = o_orderkey
WHERE e.event_id IS NULL OR event_type <> 'view' OR ts > TIMESTAMP '2024-01-20 00:00:00' OR TIMESTAMP '2024-01-20 00:00:00' - ts > INTERVAL 10 DAY""")
def lineage_freshness(spark, sf_dir):
    o, c, e = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "events"))
    lineage = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("metric"), F.col("o_orderkey").alias("evidence_id"))
    bundle = e.select(F.col("event_id").alias("evidence_id"), F.when(F.col("event_type") == "view", "current").otherwise("old").alias("freshness"), F.col("ts").cast("timestamp").alias("observed_at"))
    return evidence.stale_lineage(lineage, bundle, "2024-01-20 00:00:00", 10 * 86_400_000)


@query("""WITH l AS (SELECT n_regionkey AS "group", n_nationkey AS source, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS nth, s_suppkey % 40 AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey),
f AS (SELECT "group", id, min((nth, source)) AS turn FROM l GROUP BY ALL)
SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY turn, id) AS place, id FROM f QUALIFY place <= 32""")
def round_robin_merge(spark, sf_dir):
    from pyspark.sql import Window

    s, n = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    nth = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")) - 1
    lists = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("source"), nth.alias("nth"), (F.col("s_suppkey") % 40).alias("id"))
    return evidence.round_robin(lists)


_MEMBERS = "(SELECT o_custkey AS \"group\", CASE o_orderstatus WHEN 'F' THEN 'fresh' WHEN 'O' THEN 'stale' END AS status, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS latest_at FROM orders)"


@query(f"""SELECT "group", CASE WHEN count(*) FILTER (WHERE status = 'fresh') = count(*) THEN 'fresh' WHEN count(*) FILTER (WHERE status = 'stale') = count(*) THEN 'stale' ELSE 'partial' END AS status,
CASE WHEN count(latest_at) = count(*) THEN epoch_us(min(latest_at)) END AS earliest_us FROM {_MEMBERS} GROUP BY ALL""")
def freshness_merge(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "fresh").when(F.col("o_orderstatus") == "O", "stale")
    members = o.select(F.col("o_custkey").alias("group"), status.alias("status"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate").cast("timestamp")).alias("latest_at"))
    return evidence.merged_freshness(members).select("group", "status", F.unix_micros("latest_observation_at").alias("earliest_us"))


@query("""SELECT o_custkey, CASE WHEN len(k) = 3 THEN 'calculated,interpreted' ELSE array_to_string(list_filter(['observed', 'calculated', 'interpreted'], lambda x: list_contains(k, x)), ',') END AS kinds
FROM (SELECT o_custkey, list_distinct(list(CASE o_orderstatus WHEN 'F' THEN 'observed' WHEN 'O' THEN 'calculated' ELSE 'interpreted' END)) AS k FROM orders GROUP BY ALL)""")
def statement_merge(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "observed").when(F.col("o_orderstatus") == "O", "calculated").otherwise("interpreted")
    sets = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(kind).alias("k"))
    return sets.select("o_custkey", F.concat_ws(",", evidence.merged_statements(F.col("k"))).alias("kinds"))


# --- text --------------------------------------------------------------------------------------------------------

_SAID = "concat('Stage ', n_chars % 50, '.', n_chars % 7, ' and ', n_chars % 90, ' ft near river ', doc_id, CASE doc_id % 5 WHEN 0 THEN ' so evacuate' WHEN 1 THEN ', twelve feet; avoid the flooded roads' WHEN 2 THEN ' air quality live' ELSE '' END)"


def _said(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_SAID).alias("said"), "lang")


@query(f"""SELECT doc_id, len(regexp_extract_all(said, '(?i)\\d+(?:\\.\\d+)?\\s?ft\\b|\\btwelve feet\\b')) + 1 AS n_measurements, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS n_directives, true AS digits FROM (SELECT doc_id, {_SAID} AS said FROM documents)""")
def freetext_gate(spark, sf_dir):
    s = F.col("said")
    return _said(spark, sf_dir).select("doc_id", F.size(tx.measurements(s)).alias("n_measurements"), F.size(tx.directives(s)).alias("n_directives"), tx.has_digit(s).alias("digits"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'domains:river+air' ELSE 'domain:river' END AS route FROM documents")
def request_routing(spark, sf_dir):
    return _said(spark, sf_dir).select("doc_id", tx.route_request(F.col("said")).alias("route"))


_PRINTED = "concat(CASE doc_id % 3 WHEN 0 THEN '−' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN concat(n_chars % 999 + 1, ',', lpad(CAST(doc_id % 1000 AS STRING), 3, '0')) WHEN 1 THEN concat(n_chars % 99, '.5') WHEN 2 THEN '2 7,633' ELSE CAST(n_chars AS STRING) END, CASE doc_id % 5 WHEN 0 THEN '%' WHEN 1 THEN ' µg/m³' WHEN 2 THEN ' miles' ELSE '' END)"


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 2 AND doc_id % 4 <> 2 THEN (CASE doc_id % 3 WHEN 0 THEN -1 ELSE 1 END) * CASE doc_id % 4 WHEN 0 THEN (n_chars % 999 + 1) * 1000 + doc_id % 1000 WHEN 1 THEN n_chars % 99 + 0.5 ELSE n_chars END END::DOUBLE AS value,
CASE WHEN doc_id % 5 <> 2 AND doc_id % 4 <> 2 THEN CASE doc_id % 5 WHEN 0 THEN 'percent' WHEN 1 THEN 'ug_per_m3' ELSE 'count' END END AS unit,
CASE WHEN doc_id % 5 = 2 THEN 'unsupported-unit-syntax' WHEN doc_id % 4 = 2 THEN 'unparseable-number' END AS failure FROM documents""")
def number_normalise(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", tx.normalise_number(F.expr(_PRINTED)).alias("n"))
    return d.select("doc_id", "n.value", "n.unit", "n.failure")


# The same operators on whole documents; the made-up sentence only ends each text, so that every kind occurs.
_WHOLE = f"concat(coalesce(text, ''), ' ', {_SAID})"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _whole(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_WHOLE).alias("said"), "lang")


@query(f"""SELECT doc_id, len(q) + len(list_filter(d, lambda x: NOT contains(array_to_string(q, chr(0)), x))) AS n_measurements, len(regexp_extract_all(said, {_quoted(tx.DIRECTIVE)})) AS n_directives, regexp_matches(said, '[0-9]') AS digits
FROM (SELECT doc_id, said, regexp_extract_all(said, {_quoted(tx.QUANTITY)}) AS q, regexp_extract_all(said, {_quoted(tx.DECIMAL)}) AS d FROM (SELECT doc_id, {_WHOLE} AS said FROM documents))""")
def freetext_gate_texts(spark, sf_dir):
    s = F.col("said")
    return _whole(spark, sf_dir).select("doc_id", F.size(tx.measurements(s)).alias("n_measurements"), F.size(tx.directives(s)).alias("n_directives"), tx.has_digit(s).alias("digits"))


@query(f"""SELECT doc_id, CASE WHEN river AND air AND NOT campus THEN 'domains:river+air' WHEN campus AND (river OR air) THEN 'ambiguous' WHEN river THEN 'domain:river' WHEN air THEN 'domain:air' WHEN campus THEN 'known-source' ELSE 'unsupported' END AS route
FROM (SELECT doc_id, regexp_matches(said, {_quoted(tx.RIVER_WORDS)}) AS river, regexp_matches(said, {_quoted(tx.AIR_WORDS)}) AS air, regexp_matches(said, {_quoted(tx.CAMPUS_WORDS)}) AND regexp_matches(said, {_quoted(tx.ENROLLMENT_WORDS)}) AS campus FROM (SELECT doc_id, {_WHOLE} AS said FROM documents))""")
def request_routing_texts(spark, sf_dir):
    return _whole(spark, sf_dir).select("doc_id", tx.route_request(F.col("said")).alias("route"))


@query(f"""SELECT lang AS model, count(*) AS generations, count(*) FILTER (WHERE regexp_matches({_WHOLE}, {_quoted(tx.FRESHNESS_CLAIM)})) AS asserting FROM documents GROUP BY ALL""")
def freshness_claim_rate_texts(spark, sf_dir):
    return evaluation.freshness_rate(_whole(spark, sf_dir).select(F.col("lang").alias("model"), F.col("doc_id").alias("run_id"), F.col("said").alias("text")))


# A number as it stands in a text, with its sign, its groups and what follows as a unit.
_IN_TEXT = "[-−–]?[0-9][0-9,.]*(?: [0-9]{3})*(?:\\.[0-9]+)?(?: ?[A-Za-z%µμ][^ \\t\\r\\n]*)?"


@query(f"""WITH found AS (SELECT doc_id, unnest(range(len(l))) AS nth, unnest(l) AS printed FROM (SELECT doc_id, regexp_extract_all(concat(coalesce(text, ''), ' ', {_PRINTED}), '{_IN_TEXT}') AS l FROM documents)),
parts AS (SELECT doc_id, nth, printed, trim(regexp_extract(regexp_replace(printed, '^[−–]', '-'), '^([^A-Za-z%µμ]*)', 1)) AS number, regexp_extract(printed, '^[^A-Za-z%µμ]*((?s:.*))$', 1) AS spelling FROM found),
read AS (SELECT doc_id, nth, printed, CASE WHEN regexp_full_match(number, '-?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]{{1,3}}( [0-9]{{3}})+)(\\.[0-9]+)?') THEN replace(replace(number, ',', ''), ' ', '')::DOUBLE END AS number, CASE spelling WHEN '' THEN 'count' WHEN '%' THEN 'percent' WHEN 'µg/m³' THEN 'ug_per_m3' WHEN 'μg/m³' THEN 'ug_per_m3' END AS named FROM parts)
SELECT doc_id, nth, printed, CASE WHEN named IS NOT NULL THEN number END AS value, CASE WHEN number IS NOT NULL THEN named END AS unit, CASE WHEN named IS NULL THEN 'unsupported-unit-syntax' WHEN number IS NULL THEN 'unparseable-number' END AS failure FROM read""".replace("\\\\", "\\"))
def number_normalise_texts(spark, sf_dir):
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.expr(_PRINTED))
    found = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(whole, F.lit(_IN_TEXT), F.lit(0))).alias("nth", "printed"))
    return found.withColumn("n", tx.normalise_number(F.col("printed"))).select("doc_id", "nth", "printed", "n.value", "n.unit", "n.failure")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@example.org' END AS email FROM customer")
def email_normalise(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), "c_name", F.lit("@Example.org "))).otherwise(F.concat("c_name", F.lit(" at example")))
    return read_table(spark, sf_dir, "customer").select("c_custkey", tx.normalise_email(raw).alias("email"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS shown FROM orders")
def number_display(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tx.format_number(F.col("o_totalprice")).alias("shown"))


@query("""SELECT o_orderkey, sha256(encode('d') || '\\x00'::BLOB || unhex(lpad(printf('%X', octet_length(encode(o_orderpriority))), 8, '0')) || encode(o_orderpriority)) AS digest FROM orders""")
def row_hash(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tx.domain_hash("d", F.col("o_orderpriority")).alias("digest"))


@query("""SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS h FROM orders)""")
def uuid_identity(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tx.uuid8(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("uuid"))


# --- canonical forms -----------------------------------------------------------------------------------------------

# Amounts with no, one and two decimals, zeros and debts among them.
_CENTS = "CASE c_custkey % 4 WHEN 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) WHEN 1 THEN CAST(round(c_acctbal) AS BIGINT) * 100 WHEN 2 THEN CAST(round(c_acctbal * 10) AS BIGINT) * 10 ELSE 0 END"


def _amounts(spark, sf_dir) -> DataFrame:
    cents = F.expr(_CENTS).cast("string")
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(cents, F.lit("E-2")).cast("decimal(38,2)").alias("amount"))


@query(f"""SELECT c_custkey, (CASE WHEN c % 100 = 0 THEN c // 100 WHEN c % 10 = 0 THEN c // 10 ELSE c END)::VARCHAR AS coefficient, CASE WHEN c % 100 = 0 THEN 'i64:0' WHEN c % 10 = 0 THEN 'i64:1' ELSE 'i64:2' END AS scale, c / 100.0 AS again
FROM (SELECT c_custkey, {_CENTS} AS c FROM customer)""")
def decimal_canonical(spark, sf_dir):
    rows = _amounts(spark, sf_dir).select("c_custkey", canonical.canonical_decimal(F.col("amount"), 2).alias("d"))
    return rows.select("c_custkey", "d.coefficient", "d.scale", canonical.parse_decimal(F.col("d.coefficient"), F.col("d.scale")).cast("double").alias("again"))


@query(f"""SELECT c_custkey, '0100' || lpad(to_hex(c_custkey - 100), 16, '0') AS whole, '0200' || CASE WHEN c < 0 THEN 'FFFFFFFFFFFFFFFF' ELSE '0000000000000000' END || lpad(to_hex((CASE WHEN c % 100 = 0 THEN c // 100 WHEN c % 10 = 0 THEN c // 10 ELSE c END)::BIGINT), 16, '0') || CASE WHEN c % 100 = 0 THEN '00' WHEN c % 10 = 0 THEN '01' ELSE '02' END AS amount,
'0300' || lpad(to_hex(octet_length(encode(c_name))), 8, '0') || hex(c_name) AS name, '000000' AS no FROM (SELECT c_custkey, c_name, {_CENTS} AS c FROM customer)""")
def typed_value_bytes(spark, sf_dir):
    rows = _amounts(spark, sf_dir).withColumn("least", F.col("c_custkey") - 100)
    shown = {"whole": field("least", "integer"), "amount": field("amount", "decimal", 2), "name": field("c_name", "text"), "no": v.literal(False, "boolean")}
    return rows.select("c_custkey", *[F.hex(canonical.typed_bytes(x)).alias(n) for n, x in shown.items()])


@query("""SELECT event_id, CASE event_id % 10 WHEN 0 THEN '0201' WHEN 1 THEN '0202' WHEN 2 THEN '0203' ELSE '02' || CASE event_id % 10 WHEN 3 THEN '04' ELSE '00' END || CASE WHEN c < 0 THEN 'FFFFFFFFFFFFFFFF' ELSE '0000000000000000' END || lpad(to_hex((CASE WHEN c % 100 = 0 THEN c // 100 WHEN c % 10 = 0 THEN c // 10 ELSE c END)::BIGINT), 16, '0') || CASE WHEN c % 100 = 0 THEN '00' WHEN c % 10 = 0 THEN '01' ELSE '02' END END AS value,
'0500' || lpad(to_hex(epoch_us(ts)), 16, '0') AS ts FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)""")
def typed_value_bytes_states(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.df.select("event_id", *[F.hex(canonical.typed_bytes(rows[n])).alias(n) for n in ("value", "ts")])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders""")
def strict_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    spellings = [day, F.replace(day, F.lit("-"), F.lit("/")), F.concat(F.left(day, F.lit(4)), F.lit("-02-30")), F.concat(F.lit(" "), day), F.concat(F.left(day, F.lit(4)), F.lit("-1-2")), F.concat(day, F.lit("T00:00:00"))]
    said = F.element_at(F.array(*spellings), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", canonical.format_date(canonical.parse_date(said)).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN epoch_us(ts) END AS micros, CASE WHEN event_id % 6 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS again, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown FROM events""")
def strict_timestamps(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("shown", canonical.format_timestamp(F.col("ts")))
    s = F.col("shown")
    ways = [s, F.replace(s, F.lit("Z"), F.lit("+00:00")), F.concat(F.left(s, F.lit(23)), F.lit("Z")), F.concat(F.left(s, F.lit(11)), F.lit("24:00:00.000000Z")), F.concat(F.left(s, F.lit(17)), F.lit("60.000000Z")), F.replace(s, F.lit("T"), F.lit(" "))]
    at = canonical.parse_timestamp(F.element_at(F.array(*ways), (F.col("event_id") % 6 + 1).cast("int")))
    return e.select("event_id", F.unix_micros(at).alias("micros"), canonical.format_timestamp(at).alias("again"), "shown")


@query("SELECT l_returnflag, max(l_quantity)::DECIMAL(38,2) AS value FROM lineitem GROUP BY ALL")
def contract_by_version(spark, sf_dir):
    bounds = {1: "min", 2: "max"}
    reviewed = ContractSet("quantities", "catalog-1", {("extreme", n): MetricContract("extreme", "l_quantity", how, "decimal") for n, how in bounds.items()})
    return measure(lineitem(spark, sf_dir), reviewed.resolve("extreme", 2, "quantities", "catalog-1"), "l_returnflag").df.select("l_returnflag", "value")


# --- verification, history, graphs, evaluation -------------------------------------------------------------------


@query("""SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted-and-correct' WHEN quality = 1 THEN 'accepted-but-wrong' WHEN toxic = 0 THEN 'refused-though-correct' ELSE 'refused-and-wrong' END AS outcome, count(*) AS cases FROM labels GROUP BY ALL""")
def verify_outcomes(spark, sf_dir):
    marks = read_table(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("correct"), F.when(F.col("quality") == 0, "refused").alias("refusal"))
    return verification.outcomes(marks)


_REASONS = list(verification.REFUSAL_FAMILIES)
_JUDGED = f"""(SELECT doc_id % 3 = 0 AS probing, CASE WHEN doc_id % 7 > 0 THEN 'kind ' || doc_id % 7 END AS wrongness, toxic = 0 AS correct, CASE WHEN quality = 0 OR doc_id % 7 = 3 THEN {_REASONS}[doc_id % 10 + 1] END AS refusal FROM labels)"""


def _judged(spark, sf_dir) -> DataFrame:
    k, reasons = F.col("doc_id"), F.array(*[F.lit(x) for x in _REASONS])
    intent = F.when(k % 3 == 0, verification.PROBE).otherwise("control")
    wrongness = F.when(k % 7 > 0, F.concat(F.lit("kind "), (k % 7).cast("string")))
    refusal = F.when((F.col("quality") == 0) | (k % 7 == 3), F.element_at(reasons, (k % 10 + 1).cast("int")))
    return read_table(spark, sf_dir, "labels").select(intent.alias("intent"), wrongness.alias("wrongness"), (F.col("toxic") == 0).alias("correct"), refusal.alias("refusal"))


@query(f"""SELECT CASE WHEN probing THEN '{verification.PROBE}' ELSE 'control' END AS intent, CASE WHEN refusal IS NULL THEN 'accepted-' ELSE 'refused-' END || CASE WHEN refusal IS NULL AND correct THEN 'and-correct' WHEN refusal IS NULL THEN 'but-wrong' WHEN correct THEN 'though-correct' ELSE 'and-wrong' END AS outcome, count(*) AS cases FROM {_JUDGED} GROUP BY ALL""")
def verify_outcomes_by_intent(spark, sf_dir):
    return verification.outcomes(_judged(spark, sf_dir), "intent")


@query(f"""SELECT count(*) FILTER (WHERE refusal IS NULL) AS accepted, count(*) FILTER (WHERE refusal IS NULL AND NOT correct) AS falsely_accepted, count(DISTINCT coalesce(wrongness, '')) FILTER (WHERE probing) AS classes_probed,
count(DISTINCT coalesce(wrongness, '')) FILTER (WHERE probing AND refusal IS NOT NULL) AS classes_caught, coalesce(avg((NOT correct)::INT) FILTER (WHERE refusal IS NULL), 0)::DOUBLE AS false_acceptance_rate FROM {_JUDGED}""")
def verify_probe_report(spark, sf_dir):
    return verification.probe_report(_judged(spark, sf_dir))


@query(f"""SELECT CASE WHEN n < 3 THEN 'provenance' WHEN n < 5 THEN 'coordinates' WHEN n < 7 THEN 'contract' ELSE 'lexis' END AS family, count(*) AS cases FROM (SELECT list_position({_REASONS}, refusal) - 1 AS n FROM {_JUDGED} WHERE correct AND refusal IS NOT NULL) GROUP BY ALL""")
def verify_strictness_cost(spark, sf_dir):
    return verification.strictness_cost(_judged(spark, sf_dir))


_VERDICTS = [None, "unknown-snapshot", "snapshot-identity-mismatch", "hash-mismatch", "locator-out-of-range", "coordinate-text-mismatch", "malformed-candidate", "unsupported-normalization", "unsupported-unit-syntax", "value-not-in-extracted-text", "unit-not-in-extracted-text"]


@query(f"SELECT doc_id, [{', '.join('NULL' if v is None else repr(v) for v in _VERDICTS)}][doc_id % {len(_VERDICTS)} + 1] AS refusal FROM documents")
def verify_candidates(spark, sf_dir):
    """A candidate for each document, with every reason for a refusal among them."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n = "), F.col("n_chars").cast("string"), F.lit("% of "), F.coalesce("text", F.lit(""))).alias("body"), "n_chars")
    content = F.encode("body", "UTF-8")
    case = F.col("doc_id") % len(_VERDICTS)
    broken = lambda reason: case == _VERDICTS.index(reason)
    sealed = F.when(broken("hash-mismatch"), F.repeat(F.lit("7"), F.lit(64))).otherwise(F.sha2(content, 256))
    documents = d.where(~broken("unknown-snapshot")).select(F.col("doc_id").cast("string").alias("snapshot_id"), sealed.alias("sealed_sha256"), content.alias("content"))
    shown = F.concat(F.col("n_chars").cast("string"), F.when(broken("unsupported-unit-syntax"), "% of").otherwise("%"))
    end = 4 + F.length(shown)
    candidates = d.select(
        "doc_id", F.col("doc_id").cast("string").alias("snapshot_id"), F.when(broken("snapshot-identity-mismatch"), "0").otherwise(sealed).alias("content_sha256"), F.when(broken("coordinate-text-mismatch"), 3).otherwise(4).alias("start_byte"),
        F.when(broken("locator-out-of-range"), 1_000_000_000).when(broken("coordinate-text-mismatch"), end - 1).when(broken("malformed-candidate"), 4).otherwise(end).alias("end_byte"), shown.alias("extracted_text"),
        F.when(broken("unsupported-normalization"), "2").otherwise("1").alias("normalisation"), F.when(broken("value-not-in-extracted-text"), -1.0).otherwise(F.col("n_chars").cast("double")).alias("value"), F.when(broken("unit-not-in-extracted-text"), "count").otherwise("percent").alias("unit"),
    )
    return verification.verify(candidates, documents).select("doc_id", "refusal")


@query("SELECT c_custkey AS id, o_orderkey AS head, o_orderpriority AS content FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) h JOIN customer ON c_custkey = o_custkey JOIN orders o USING (o_orderkey)")
def head_version_join(spark, sf_dir):
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    documents = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("head")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.lit("t").alias("tenant"), "head")
    versions = history.addressed(o.select(F.col("o_custkey").alias("document_id"), F.lit("t").alias("tenant"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("content")))
    return history.heads(documents, versions).select("id", "head", "content")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_list(spark, sf_dir):
    return history.recent(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), 100).select("id")


@query("SELECT o_orderkey AS claim_id FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def uncovered_claims(spark, sf_dir):
    claims = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("draft").alias("state"))
    return evidence.uncovered_claims(claims, read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"))).select("claim_id")


@query("SELECT o_orderkey AS id, sha256(o_orderpriority) AS sha256 FROM orders")
def content_addresses(spark, sf_dir):
    return history.addressed(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))).select("id", "sha256")


@query("""WITH RECURSIVE r(node) AS (SELECT c_custkey FROM customer WHERE c_custkey % 97 = 1 UNION SELECT o_orderkey % 3000 FROM r JOIN orders ON o_custkey = node) SELECT node FROM r""")
def reachability_closure(spark, sf_dir):
    with_checkpoints(spark)
    edges = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 3000).alias("dst"))
    roots = read_table(spark, sf_dir, "customer").where("c_custkey % 97 = 1").select(F.col("c_custkey").alias("node"))
    return reachability.reachable(edges, roots)


_TYPED_EDGES = {  # kind and key at both ends, and the relation that holds them
    "nation": ("region", "n_regionkey", "nation", "n_nationkey"),
    "customer": ("nation", "c_nationkey", "customer", "c_custkey"),
    "supplier": ("nation", "s_nationkey", "supplier", "s_suppkey"),
    "orders": ("customer", "o_custkey", "order", "o_orderkey"),
    "lineitem": ("order", "l_orderkey", "part", "l_partkey"),
    "lineitem AS supplied": ("supplier", "l_suppkey", "order", "l_orderkey"),
}
_TYPED_SQL = " UNION ".join(f"SELECT '{a}:' || {x} AS src, '{b}:' || {y} AS dst FROM {t}" for t, (a, x, b, y) in _TYPED_EDGES.items())


@query(f"""WITH RECURSIVE edges AS MATERIALIZED ({_TYPED_SQL}), r(node) AS (SELECT 'region:' || r_regionkey FROM region UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r""")
def reachability_relations(spark, sf_dir):
    with_checkpoints(spark)
    relations = [(a, b, read_table(spark, sf_dir, table.split()[0]).select(F.col(x).cast("bigint").alias("src"), F.col(y).cast("bigint").alias("dst"))) for table, (a, x, b, y) in _TYPED_EDGES.items()]
    found = reachability.reachable_relations(relations, {"region": read_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("node"))})
    named = found.select(F.concat("kind", F.lit(":"), F.col("node").cast("string")).alias("node"))
    return named.where("node IS NOT NULL").union(named.where("node IS NULL").distinct())  # of null keys, whatever their kinds, one


@query("""SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN 'declared-but-reachable' ELSE 'undeclared' END AS problem FROM customer WHERE (c_custkey % 3 = 0 AND c_custkey % 2 = 0) OR (c_custkey % 3 <> 0 AND c_custkey % 2 <> 0)""")
def reachability_differences(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return reachability.differences(c.where("node % 3 = 0"), c.where("node % 2 = 0"), c)


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS node, 'undeclared' AS problem FROM c WHERE k % 2 <> 0 AND k % 3 <> 0 UNION ALL SELECT k, 'declared-but-reachable' FROM c WHERE k % 6 = 0
UNION ALL SELECT -1 - k, 'unknown' FROM c WHERE k % 10 = 0 UNION ALL SELECT k, 'repeated' FROM c WHERE k % 9 = 0 UNION ALL SELECT -1 - k, 'unknown-root' FROM c WHERE k % 50 = 0""")
def reachability_problems(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    declared = nodes.where("node % 3 = 0").union(nodes.where("node % 9 = 0")).union(nodes.where("node % 10 = 0").select(-1 - F.col("node")))
    roots = nodes.where("node % 50 = 0").select((-1 - F.col("node")).alias("node")).union(nodes.where("node % 2 = 0"))
    return reachability.differences(declared, roots, nodes, roots)


_RUNS = "SELECT conv_id, min(role) AS model, CASE WHEN conv_id % 4 = 0 THEN 'control' ELSE 'probe' END AS category, conv_id % 5 <> 0 AS accepted, count(*) AS attempts, conv_id % 3 AS n_reached, conv_id % 11 AS n_leaked, conv_id % 2 AS n_digits FROM (SELECT conv_id, concat('m', conv_id % 3) AS role FROM conversations) GROUP BY conv_id"


@query(f"""SELECT model, count(*) AS generations, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE n_reached > 0) AS reached, count(*) FILTER (WHERE n_leaked > 0) AS leaked, count(*) FILTER (WHERE category = 'control' AND NOT accepted) AS control_failures,
count(*) FILTER (WHERE n_digits > 0) AS digits, coalesce(avg(attempts) FILTER (WHERE accepted), 0)::DOUBLE AS mean_attempts, count(*) FILTER (WHERE NOT accepted) AS no_dashboard FROM ({_RUNS}) GROUP BY model""")
def eval_summary(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("attempts"))
    k = F.col("conv_id")
    runs = c.select(F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), F.when(k % 4 == 0, "control").otherwise("probe").alias("category"), (k % 5 != 0).alias("accepted"), "attempts", (k % 3).alias("n_reached"), (k % 11).alias("n_leaked"), (k % 2).alias("n_digits"))
    return evaluation.summarise(runs)


@query(f"""SELECT lang AS model, count(*) AS generations, count(*) FILTER (WHERE doc_id % 5 = 2) AS asserting FROM documents GROUP BY ALL""")
def freshness_claim_rate(spark, sf_dir):
    return evaluation.freshness_rate(_said(spark, sf_dir).select(F.col("lang").alias("model"), F.col("doc_id").alias("run_id"), F.col("said").alias("text")))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY ALL")
def tally_roles(spark, sf_dir):
    return evaluation.tally(read_table(spark, sf_dir, "conversations"), "role")


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json, sha256(json) AS sha256 FROM nation""")
def canonical_rows(spark, sf_dir):
    return canonical_json(read_table(spark, sf_dir, "nation"))
