"""Facts about monitoring stations from long observation tables.

``observations`` has site_id, slot (primary or secondary), at (timestamp), value (double) and ordinal, the position in
the payload; ``stations`` has site_id, name, group, the labels of its two readings and their units. Each step is one
grouping by station with partial aggregation; no history is gathered in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import format_number, to_fixed_2

HOURS = (1, 6, 24)
TOLERANCE_MINUTES = 90
STALE_HOURS = 2


@dataclass(frozen=True)
class Policy:
    """A domain's numbers: change that counts as a direction, and rise that is ranked."""

    direction_tolerance: float
    material_rise: float


# Fixed values.
RIVER = Policy(0.05, 0.05)
AIR = Policy(2.0, 5.0)


def latest(observations: DataFrame) -> DataFrame:
    """(site_id, slot, at, value, n_points): the last observation by time, of equal times the last given."""
    last = F.max(F.struct("at", "ordinal", "value")).alias("last")
    found = observations.groupBy("site_id", "slot").agg(last, F.count(F.lit(1)).alias("n_points"))
    return found.select("site_id", "slot", "last.at", "last.value", "n_points")


def changes(observations: DataFrame, hours: tuple[int, ...] = HOURS) -> DataFrame:
    """(site_id, change_<h>h ...): as-of changes of the primary reading.

    The earlier reading is the last at or before the latest's time less h hours, and no more than 90 minutes before it.
    """
    primary = observations.where("slot = 'primary'")
    now = latest(primary).select("site_id", F.col("at").alias("now_at"), F.col("value").alias("now_value"))
    joined = primary.join(now, "site_id")
    target = lambda h: F.col("now_at") - F.expr(f"INTERVAL {h} HOURS")
    prior = [F.max(F.when((F.col("at") <= target(h)) & (F.col("at") >= target(h) - F.expr(f"INTERVAL {TOLERANCE_MINUTES} MINUTES")), F.struct("at", "ordinal", "value"))).alias(f"prior_{h}") for h in hours]
    found = joined.groupBy("site_id").agg(F.first("now_value").alias("now_value"), *prior)
    return found.select("site_id", *[to_fixed_2(F.col("now_value") - F.col(f"prior_{h}.value")).alias(f"change_{h}h") for h in hours])


def freshness(at: Column, as_of: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(at)
    return F.when(at.isNull(), "missing").when(age > STALE_HOURS * 3_600_000_000, "stale").otherwise("fresh")


def direction(change_1h: Column, change_6h: Column, tolerance: float, primary_freshness: Column) -> Column:
    change = F.coalesce(change_1h, change_6h)
    told = F.when(change > tolerance, "rising").when(change < -tolerance, "falling").when(change.isNotNull(), "steady").otherwise("unknown")
    return F.when(primary_freshness == "fresh", told).otherwise("unknown")


def station_metrics(stations: DataFrame, observations: DataFrame, as_of, policy: Policy = RIVER) -> DataFrame:
    """One row per station: latest readings, changes, direction, freshness and data issues."""
    as_of = F.lit(as_of).cast("timestamp")
    last = latest(observations)
    sides = last.groupBy("site_id").agg(*[F.max(F.when(F.col("slot") == slot, F.col(c))).alias(f"{slot}_{c}") for slot in ("primary", "secondary") for c in ("at", "value", "n_points")])
    rows = stations.join(sides, "site_id", "left").join(changes(observations), "site_id", "left")
    for slot in ("primary", "secondary"):
        rows = rows.withColumn(f"{slot}_freshness", freshness(F.col(f"{slot}_at"), as_of))
    issue = lambda slot: F.when(F.col(f"{slot}_freshness") == "missing", F.concat(f"{slot}_label", F.lit(" readings are missing"))).when(F.col(f"{slot}_freshness") == "stale", F.concat(f"{slot}_label", F.lit(" reading is more than two hours old")))
    worst = lambda what: (F.col("primary_freshness") == what) | (F.col("secondary_freshness") == what)
    return rows.select(
        *stations.columns,
        F.col("primary_value").alias("latest_primary"),
        F.col("secondary_value").alias("latest_secondary"),
        F.greatest("primary_at", "secondary_at").alias("latest_at"),
        *[F.col(f"change_{h}h") for h in HOURS],
        F.coalesce("primary_n_points", F.lit(0)).alias("primary_points"),
        direction(F.col("change_1h"), F.col("change_6h"), policy.direction_tolerance, F.col("primary_freshness")).alias("direction"),
        F.when(worst("missing"), "missing").when(worst("stale"), "stale").otherwise("fresh").alias("freshness"),
        "primary_freshness",
        "secondary_freshness",
        F.filter(F.array(issue("primary"), issue("secondary")), lambda x: x.isNotNull()).alias("issues"),
    )


def moving(metrics: DataFrame, way: str) -> DataFrame:
    """Stations that are rising or falling (way)."""
    return metrics.where((F.col("primary_freshness") == "fresh") & (F.col("direction") == way))


def stale_or_missing(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("freshness") != "fresh") | (F.size("issues") > 0))


def ranked(metrics: DataFrame, policy: Policy = RIVER) -> DataFrame:
    """Fresh and complete stations by how much they rose in an hour, if materially; ties by site, as rows have no order.

    (Compiled documents keep the plan's order among ties.)
    """
    sound = metrics.where((F.col("change_1h") > policy.material_rise) & (F.col("freshness") == "fresh") & (F.size("issues") == 0))
    return sound.orderBy(F.desc("change_1h"), "site_id")


def alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(id, severity, title, detail, site_id): one alert per data issue and per exceeded threshold, or an all-clear.

    ``thresholds`` has id, label, site_id and above; a reading just at the level has not exceeded it.
    """
    named = metrics.select("site_id", "group", "freshness", "primary_freshness", "latest_primary", "primary_unit", F.posexplode_outer("issues").alias("nth", "issue"))
    quality = named.where("issue IS NOT NULL").select(
        F.concat_ws("-", "site_id", F.lit("quality"), "nth").alias("id"),
        F.when(F.col("freshness") == "fresh", "attention").otherwise("warning").alias("severity"),
        F.col("group").alias("title"), F.col("issue").alias("detail"), "site_id",
    )
    above = thresholds.join(metrics, "site_id").where((F.col("primary_freshness") == "fresh") & (F.col("latest_primary") > F.col("above")))
    unit = F.coalesce(F.col("primary_unit"), F.lit(""))
    told = F.concat("group", F.lit(" is "), format_number(F.col("latest_primary")), F.lit(" "), unit, F.lit(", above the user threshold of "), format_number(F.col("above")), F.lit(" "), unit, F.lit("."))
    exceeded = above.select("id", F.lit("attention").alias("severity"), F.col("label").alias("title"), told.alias("detail"), "site_id")
    found = quality.unionByName(exceeded)
    clear = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("no-alerts").alias("id"), F.lit("info").alias("severity"), F.lit("No configured thresholds are active").alias("title"),
        F.lit("All current data-quality and user-defined threshold checks are clear.").alias("detail"), F.lit(None).cast("string").alias("site_id"),
    )
    return found.unionByName(clear)


def latest_observation(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max("latest_at").alias("latest_observation_at"))


EVIDENCE = ("id", "kind", "label", "source_name", "source_url", "observed_at", "retrieved_at", "detail", "confidence")


def station_evidence(metrics: DataFrame, as_of, additional: DataFrame | None = None) -> DataFrame:
    """(EVIDENCE): one observed record per station, one for the calculations, and the caller's own (``additional``).

    Stations may have kind_label, source_name, source_url and retrieved_at; what they lack is null, or left out of the label.
    """
    has = set(metrics.columns)
    own = lambda c, kind="string": (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    words = ["group", *(["kind_label"] if "kind_label" in has else []), "site_id"]
    observed = metrics.select(
        F.concat(F.lit("station-"), "site_id").alias("id"), F.lit("observed").alias("kind"), F.concat_ws(" ", *words).alias("label"), own("source_name"), own("source_url"), F.col("latest_at").alias("observed_at"), own("retrieved_at", "timestamp"),
        F.concat("primary_label", F.lit(" and "), "secondary_label", F.lit(" observations for "), "name", F.lit(".")).alias("detail"), F.lit("high").alias("confidence"),
    )
    at, none = F.lit(as_of).cast("timestamp"), F.lit(None)
    made = {"id": F.lit("calculations"), "kind": F.lit("calculated"), "label": F.lit("Calculations"), "source_name": F.lit("tidemark"), "source_url": none.cast("string"), "observed_at": none.cast("timestamp"), "retrieved_at": at,
            "detail": F.lit("Changes over 1, 6 and 24 hours, directions and rankings."), "confidence": F.lit("high")}
    found = observed.unionByName(metrics.sparkSession.range(1).select(*[made[c].alias(c) for c in EVIDENCE]))
    return found if additional is None else found.unionByName(additional.select(*EVIDENCE))


def scaled(points: DataFrame, by: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Min-max scaling of a value within each ``by``, for trend lines and map places; a flat series lies in the middle."""
    bounds = points.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    share = F.when(span > 0, (F.col(value) - F.col("_low")) / span).otherwise(F.lit(0.5))
    return points.join(bounds, by).withColumn(f"{value}_scaled", F.lit(low) + share * (high - low)).drop("_low", "_high")


def map_places(points: DataFrame, by: str, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Percentages from the left and the top at which stations stand on the map of each ``by``, from one aggregate of its bounds."""
    ends = points.groupBy(by).agg(*[how(c).alias(f"_{n}_{c}") for c in (latitude, longitude) for n, how in (("low", F.min), ("high", F.max))])
    span = lambda c: F.col(f"_high_{c}") - F.col(f"_low_{c}")
    share = lambda c: F.when(span(c) > 0, (F.col(c) - F.col(f"_low_{c}")) / span(c)).otherwise(F.lit(0.0))
    # Margins and extents of the map.
    return points.join(ends, by).withColumn("left", 12 + share(longitude) * 76).withColumn("top", 12 + (1 - share(latitude)) * 70).drop(*[c for c in ends.columns if c != by])
