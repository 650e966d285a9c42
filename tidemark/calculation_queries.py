"""Registered queries over rates and their evidence, the order of groups, and digests of outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.values import field
from tidemark.operators import ordering, rates
from tidemark.operators.rowsets import Rowset
from tidemark.queries import HE
from tidemark.registry import query
from tidemark.sources.tables import read_table

# --- rates -----------------------------------------------------------------------------------------------------------

_TO = "CASE user_id % 3 WHEN 0 THEN 'JPY' ELSE 'EUR' END"
_CENTS_SQL = "round(value * 100)::HUGEINT"


@query(f"""WITH c AS (SELECT event_id, ts, {_CENTS_SQL} AS cents, {_TO} AS currency FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT event_id AS evidence_id, ts AS seen, {_CENTS_SQL} + 1 AS rate, {_TO} AS currency FROM events WHERE event_type = 'signup'),
f AS (SELECT c.*, CASE WHEN ts - seen <= INTERVAL 1 HOUR THEN evidence_id END AS evidence_id, CASE WHEN ts - seen <= INTERVAL 1 HOUR THEN rate END AS rate FROM c ASOF LEFT JOIN r ON c.currency = r.currency AND c.ts >= r.seen)
SELECT event_id, evidence_id, rate::DOUBLE AS rate_e4, CASE WHEN rate IS NULL THEN NULL WHEN currency = 'JPY' THEN {HE("cents * rate", "1000000")} ELSE {HE("cents * rate", "10000")} END::BIGINT AS coins FROM f""")
def fx_rate_as_of(spark, sf_dir):
    """Amounts by the latest rate of their pair within the hour before; two thirds of the amounts have one pair."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"), F.round("value", 2).cast("decimal(12,2)").alias("amount"), F.lit("USD").alias("from_currency"), F.expr(_TO).alias("to_currency"))
    known = e.where("event_type = 'signup'").select("from_currency", "to_currency", F.col("event_id").alias("evidence_id"), ((F.col("amount") * 100 + 1).cast("decimal(12,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(12,4)").alias("rate"), F.col("at").alias("observed_at"))
    found = rates.rates_as_of(e.where("event_type IN ('view', 'click')"), known, 3_600_000)
    coins = lambda currency, scale: (rates.converted(F.col("amount"), 2, F.col("rate"), 4, currency) * F.lit(10**scale)).cast("bigint")
    return found.select("event_id", "evidence_id", (F.col("rate") * 10_000).cast("double").alias("rate_e4"), F.when(F.col("to_currency") == "JPY", coins("JPY", 0)).otherwise(coins("EUR", 2)).alias("coins"))


_CASES = 41
_RULES = list(rates.FX_RULES)
# Cases beside one for each rule: just at the largest age (sound), and two rules broken of which the first is told.
_EXPECTED = [(i, r) for i, r in enumerate(_RULES)] + [(len(_RULES) + 1, "rate")]


@query(f"""SELECT o_orderkey AS calculation_id, rule, CASE WHEN rule IN ('not-current', 'from-the-future', 'too-old') THEN 'stale_fx' WHEN rule IS NOT NULL THEN 'missing_fx_evidence' END AS code
FROM orders LEFT JOIN (VALUES {', '.join(f"({i}, '{r}')" for i, r in _EXPECTED)}) AS e(nth, rule) ON o_orderkey % {_CASES} = nth""")
def fx_evidence_rules(spark, sf_dir):
    """A calculation for each order with a bundle, an entry, a rate and a lineage of its own; each rule is broken by some."""
    k = F.col("o_orderkey")
    case, text = k % _CASES, k.cast("string")
    breaks = lambda *rules: case.isin(*[_RULES.index(r) for r in rules])
    either = lambda rule, bad, good: F.when(breaks(rule), bad).otherwise(good)
    o = read_table(spark, sf_dir, "orders").select(k)
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    evidence, bundle, digest = F.concat(F.lit("fx"), text), F.concat(F.lit("b"), text), F.sha2(text, 256)
    moved = lambda seconds: at + F.expr(f"INTERVAL {seconds} SECONDS")
    seen = F.when(breaks("from-the-future"), moved(1)).when(breaks("too-old") | (case == len(_RULES) + 1), moved(-86_401)).when(case == len(_RULES), moved(-86_400)).otherwise(moved(-60))
    calculations = o.select(
        k.alias("calculation_id"), evidence.alias("fx_evidence_id"), either("no-identity", F.lit(None), digest).alias("fx_evidence_sha256"), bundle.alias("bundle_id"), F.sha2(bundle, 256).alias("bundle_sha256"),
        text.alias("snapshot_id"), F.sha2(F.concat(F.lit("s"), text), 256).alias("source_sha256"), at.alias("evaluated_at"),
    )
    said = F.array(F.lit("0.9250"), either("two-rates", F.lit("0.9251"), F.lit("0.9250")))
    conversions = o.select(k.alias("calculation_id"), either("other-evidence", F.lit("fx"), evidence).alias("fx_evidence_id"), F.lit("USD").alias("from_currency"), F.lit("EUR").alias("to_currency"), F.explode(said.cast("array<decimal(12,4)>")).alias("rate"))
    bundles = o.where(~breaks("bundle-identity")).select(bundle.alias("bundle_id"), F.sha2(F.concat(bundle, either("bundle-hash", F.lit("x"), F.lit(""))), 256).alias("bundle_sha256"))
    entries = o.where(~breaks("not-in-bundle")).select(
        bundle.alias("bundle_id"), evidence.alias("evidence_id"), F.sha2(F.concat(text, either("entry-hash", F.lit("x"), F.lit(""))), 256).alias("evidence_sha256"), F.concat(text, either("other-snapshot", F.lit("x"), F.lit(""))).alias("snapshot_id"),
        F.sha2(F.concat(F.lit("s"), text, either("other-source", F.lit("x"), F.lit(""))), 256).alias("source_sha256"), either("instant", moved(-61), seen).alias("observed_at"), either("not-current", F.lit("old"), F.lit("current")).alias("freshness"),
    )
    bodies = o.where(~breaks("no-evidence")).select(
        evidence.alias("evidence_id"), F.sha2(F.concat(text, either("body-hash", F.lit("x"), F.lit(""))), 256).alias("evidence_sha256"), F.lit("USD").alias("from_currency"), either("direction", F.lit("JPY"), F.lit("EUR")).alias("to_currency"),
        F.when(breaks("rate") | (case == len(_RULES) + 1), "0.9260").otherwise("0.9250").cast("decimal(12,4)").alias("rate"), seen.alias("observed_at"),
    )
    lineage = o.where(~breaks("outside-lineage")).select(k.alias("calculation_id"), evidence.alias("evidence_id"))
    return rates.check_fx(calculations, conversions, bundles, entries, bodies, lineage)


# --- orders that all runs share --------------------------------------------------------------------------------------

_LENGTH = "unhex(lpad(printf('%X', octet_length(encode({0}))), 8, '0'))"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"""WITH k AS (SELECT l_orderkey, l_returnflag, l_linenumber - 3 AS step, '0300' || lpad(to_hex(octet_length(encode(l_returnflag))), 8, '0') || hex(l_returnflag) || '0100' || lpad(to_hex((l_linenumber - 3)::BIGINT), 16, '0') AS x FROM lineitem),
g AS (SELECT x, l_returnflag, step, count(*) AS n_rows, min(l_orderkey) AS first_row FROM k GROUP BY ALL),
d AS (SELECT *, sha256(encode('{ordering.GROUP_DOMAIN}') || '\\x00'::BLOB || {_LENGTH.format('x')} || encode(x)) AS h FROM g)
SELECT row_number() OVER (ORDER BY x) - 1 AS place, {_UUID} AS group_id, n_rows, first_row, l_returnflag, step::BIGINT AS step FROM d""")
def group_canonical_order(spark, sf_dir):
    """Groups in the order of their keys' bytes, where negative numbers come last, with ids derived from those bytes."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber") - 3).alias("step"))
    return ordering.ordered_groups(Rowset(rows, {"l_returnflag": field("l_returnflag", "text"), "step": field("step", "integer")}, "l_orderkey"), "l_returnflag", "step")


@query(f"""WITH j AS (SELECT o_orderpriority, '{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}}' AS json FROM orders),
r AS (SELECT sha256(json) AS d, row_number() OVER (ORDER BY o_orderpriority DESC, json) - 1 AS n FROM j),
one AS (SELECT n // {ordering.FAN} AS n, sha256(string_agg(d, '' ORDER BY n)) AS d FROM r GROUP BY n // {ordering.FAN}),
two AS (SELECT n // {ordering.FAN} AS n, sha256(string_agg(d, '' ORDER BY n)) AS d FROM one GROUP BY n // {ordering.FAN}),
top AS (SELECT (SELECT count(*) FROM r) AS cardinality, (SELECT d FROM two) AS d)
SELECT cardinality, sha256(encode('{ordering.OUTPUT_DOMAIN}') || '\\x00'::BLOB || {_LENGTH.format("cardinality || ':' || d")} || encode(cardinality || ':' || d)) AS sha256 FROM top""")
def output_digest(spark, sf_dir):
    """One digest of all orders in falling order of priority."""
    return ordering.output_digest(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [F.desc("o_orderpriority")])
