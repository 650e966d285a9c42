"""Currency rates as a relation: the latest before a time, and the evidence that a conversion must have.

An as-of join must not gather a pair's whole history in one task, however many conversions have that pair. Time is cut into
slots of a fraction of the largest age; each slot knows the last rate of the slots before it that can still count, so a
window over one slot sees all it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import CalculationError
from tidemark.functions import exact
from tidemark.functions.units import CURRENCIES, RATE_MAX_AGE_MILLIS

#: Slots of the largest age.
SLOTS = 24


def rates_as_of(conversions: DataFrame, rates: DataFrame, max_age_millis: int = RATE_MAX_AGE_MILLIS) -> DataFrame:
    """``conversions`` with evidence_id, rate and observed_at of the latest rate of their pair at or before ``at``, or nulls.

    ``conversions`` has from_currency, to_currency and at; ``rates`` evidence_id, from_currency, to_currency, rate and
    observed_at. A rate older than ``max_age_millis`` doesn't count; of rates at one instant the largest evidence_id does.
    """
    pair, width = ["from_currency", "to_currency"], max(1, max_age_millis * 1000 // SLOTS)
    micros = F.unix_micros("at")
    slot = F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))
    told = F.struct("at", "evidence_id", "rate")
    known = rates.select(*pair, F.col("observed_at").alias("at"), "evidence_id", "rate").where("at IS NOT NULL").withColumn("slot", slot)
    last = known.groupBy(*pair, "slot").agg(F.max(told).alias("told"))
    before = last.select(*pair, F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + SLOTS + 1)).alias("slot"), "told")
    seeds = before.groupBy(*pair, "slot").agg(F.max("told").alias("told"))
    asked = conversions.select(*pair, "at", F.struct(*conversions.columns).alias("row")).withColumn("slot", slot)
    empty = F.lit(None)
    rows = asked.select(*pair, "slot", "at", F.lit(1).alias("kind"), "row", empty.cast(last.schema["told"].dataType).alias("told"))
    row_kind = asked.schema["row"].dataType
    rows = rows.unionByName(known.select(*pair, "slot", "at", F.lit(0).alias("kind"), empty.cast(row_kind).alias("row"), told.alias("told")))
    rows = rows.unionByName(seeds.select(*pair, "slot", F.lit(None).cast(dict(known.dtypes)["at"]).alias("at"), F.lit(0).alias("kind"), empty.cast(row_kind).alias("row"), "told"))
    order = Window.partitionBy(*pair, "slot").orderBy(F.asc_nulls_first("at"), "kind", F.col("told.evidence_id"))
    latest = F.last("told", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("told", latest).where("kind = 1")
    young = F.unix_micros("row.at") - F.unix_micros("told.at") <= max_age_millis * 1000
    return found.select("row.*", *[F.when(young, F.col(f"told.{c}")).alias(n) for c, n in (("evidence_id", "evidence_id"), ("rate", "rate"), ("at", "observed_at"))])


def converted(amount: Column, amount_scale: int, rate: Column, rate_scale: int, target: str) -> Column:
    """amount * rate in the target's currency, with as many decimals as its smallest coin, rounded once, half to even."""
    if target not in CURRENCIES:
        raise CalculationError("currency_mismatch", target)
    product = (exact.coefficient(amount, amount_scale) * exact.coefficient(rate, rate_scale)).cast(exact.WHOLE)
    coin = CURRENCIES[target]
    return exact.ratio(product, exact.power(amount_scale + rate_scale), coin)


# Of each rule, in order: its name and the code that it fails with.
FX_RULES = {
    "no-identity": "missing_fx_evidence",
    "two-rates": "missing_fx_evidence",
    "other-evidence": "missing_fx_evidence",
    "no-evidence": "missing_fx_evidence",
    "bundle-identity": "missing_fx_evidence",
    "bundle-hash": "missing_fx_evidence",
    "not-in-bundle": "missing_fx_evidence",
    "entry-hash": "missing_fx_evidence",
    "body-hash": "missing_fx_evidence",
    "other-snapshot": "missing_fx_evidence",
    "other-source": "missing_fx_evidence",
    "direction": "missing_fx_evidence",
    "rate": "missing_fx_evidence",
    "instant": "missing_fx_evidence",
    "outside-lineage": "missing_fx_evidence",
    "not-current": "stale_fx",
    "from-the-future": "stale_fx",
    "too-old": "stale_fx",
}


def _packed(digest: Column) -> Column:
    """A digest in half the bytes; texts that aren't 64 small hexadecimal digits as they are, after a byte. Equal only if they were."""
    return F.when(F.rlike(digest, F.lit(r"\A[0-9a-f]{64}\z")), F.unhex(digest)).otherwise(F.concat(F.lit(b"\x00"), F.encode(digest, "UTF-8")))


def check_fx(calculations: DataFrame, conversions: DataFrame, bundles: DataFrame, entries: DataFrame, rates: DataFrame, lineage: DataFrame) -> DataFrame:
    """(calculation_id, rule, code): of each calculation that converts money the first rule that it breaks, or nulls.

    ``calculations``: calculation_id, fx_evidence_id, fx_evidence_sha256, bundle_id, bundle_sha256, snapshot_id, source_sha256,
    evaluated_at. ``conversions``: calculation_id, fx_evidence_id, from_currency, to_currency, rate (a decimal). ``bundles``:
    bundle_id, bundle_sha256. ``entries``: bundle_id, evidence_id, evidence_sha256, snapshot_id, source_sha256, observed_at,
    freshness. ``rates``: evidence_id, evidence_sha256, from_currency, to_currency, rate, observed_at. ``lineage``:
    calculation_id, evidence_id. A calculation's bundle is looked up by id, its evidence in the bundle and by itself: each
    relation is read once and joined once, on keys.
    """
    c = F.col
    differ = lambda a, b: ~c(a).eqNullSafe(c(b))
    # Each join keeps, of what it compares, only which rules are broken (a bit each) and what later joins need, so rows shrink
    # on their way. Digests travel as bytes.
    bits = {rule: 1 << i for i, rule in enumerate(FX_RULES)}
    breaks = lambda **of: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.coalesce(on, F.lit(False)), bits[r.replace("_", "-")]).otherwise(0) for r, on in of.items()])
    packed = lambda df: df.select(*[_packed(c(n)).alias(n) if n.endswith("sha256") else n for n in df.columns])
    there = F.lit(True).alias("there")

    rows = packed(calculations).withColumn("broken", breaks(no_identity=c("fx_evidence_id").isNull() | c("fx_evidence_sha256").isNull()))
    entry = packed(entries).select("bundle_id", c("evidence_id").alias("fx_evidence_id"), c("evidence_sha256").alias("entry_sha256"), c("snapshot_id").alias("entry_snapshot"), c("source_sha256").alias("entry_source"), c("observed_at").alias("entry_at"), (c("freshness") == "current").alias("current"), there)
    found = breaks(
        not_in_bundle=c("there").isNull(), entry_hash=differ("entry_sha256", "fx_evidence_sha256"), other_snapshot=differ("entry_snapshot", "snapshot_id"),
        other_source=differ("entry_source", "source_sha256"), not_current=~F.coalesce("current", F.lit(False)),
    )
    rows = rows.join(entry, ["bundle_id", "fx_evidence_id"], "left").select("calculation_id", "fx_evidence_id", "fx_evidence_sha256", "bundle_id", "bundle_sha256", "evaluated_at", "entry_at", c("broken").bitwiseOR(found).alias("broken"))

    bundle = packed(bundles).select("bundle_id", c("bundle_sha256").alias("real_sha256"), there)
    found = breaks(bundle_identity=c("there").isNull(), bundle_hash=differ("real_sha256", "bundle_sha256"))
    rows = rows.join(bundle, "bundle_id", "left").select("calculation_id", "fx_evidence_id", "fx_evidence_sha256", "evaluated_at", "entry_at", c("broken").bitwiseOR(found).alias("broken"))

    body = packed(rates).select(c("evidence_id").alias("fx_evidence_id"), c("evidence_sha256").alias("body_sha256"), c("from_currency").alias("body_from"), c("to_currency").alias("body_to"), c("rate").alias("body_rate"), c("observed_at").alias("body_at"), there)
    age = F.unix_micros("evaluated_at") - F.unix_micros("body_at")
    found = breaks(
        no_evidence=c("there").isNull(), body_hash=differ("body_sha256", "fx_evidence_sha256"), instant=differ("body_at", "entry_at"), from_the_future=age < 0, too_old=age > RATE_MAX_AGE_MILLIS * 1000,
    )
    rows = rows.join(body, "fx_evidence_id", "left").select("calculation_id", "fx_evidence_id", "body_from", "body_to", "body_rate", c("broken").bitwiseOR(found).alias("broken"))

    line = lineage.select("calculation_id", c("evidence_id").alias("fx_evidence_id"), there).distinct()
    rows = rows.join(line, ["calculation_id", "fx_evidence_id"], "left").withColumn("broken", c("broken").bitwiseOR(breaks(outside_lineage=c("there").isNull()))).drop("there")

    told = conversions.groupBy("calculation_id").agg(
        F.min(F.struct("from_currency", "to_currency")).alias("pair"), F.max(F.struct("from_currency", "to_currency")).alias("last_pair"), F.min("rate").alias("said"), F.max("rate").alias("last_said"),
        F.min("fx_evidence_id").alias("cited"), F.max("fx_evidence_id").alias("last_cited"), F.count_if(F.col("fx_evidence_id").isNull()).alias("uncited"),
    )
    found = breaks(
        two_rates=(c("pair") != c("last_pair")) | (c("said") != c("last_said")), other_evidence=(c("uncited") > 0) | differ("cited", "fx_evidence_id") | differ("last_cited", "fx_evidence_id"),
        direction=differ("body_from", "pair.from_currency") | differ("body_to", "pair.to_currency"), rate=differ("body_rate", "said"),
    )
    rows = rows.join(told, "calculation_id").select("calculation_id", c("broken").bitwiseOR(found).alias("broken"))
    first = F.coalesce(*[F.when(c("broken").bitwiseAND(F.lit(bits[rule])) != 0, F.lit(rule)) for rule in FX_RULES])
    code = F.create_map(*[F.lit(x) for pair in FX_RULES.items() for x in pair])
    return rows.select("calculation_id", first.alias("rule")).withColumn("code", F.try_element_at(code, "rule"))
