"""Air monitor readings from JSON bundles of locations and hourly measurements by sensor.

``air_findings`` names what is wrong with which bundle, and ``parse_air`` reads sound ones; ``read_air`` fails instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shapes import Contract, finding, findings

SCHEMA = """
  retrievedAt string,
  locations struct<results: array<struct<id: bigint, name: string, locality: string, isMonitor: boolean, coordinates: struct<latitude: double, longitude: double>,
    sensors: array<struct<id: bigint, parameter: struct<name: string, units: string, displayName: string>>>>>>,
  hours map<string, struct<results: array<struct<value: double, period: struct<datetimeTo: struct<utc: string>>>>>>
"""
# Parameter, slot and unit; the limits of one bundle.
PARAMETERS = {"primary": ("pm25", "µg/m³"), "secondary": ("o3", "ppm")}
MAX_LOCATIONS, MAX_MEASUREMENTS = 200, 20_000
RECORDS = {
    "bundle": {"retrievedAt": "instant", "locations": "locations", "hours": "map/hours"},
    "locations": {"results": f"list/1/{MAX_LOCATIONS}/location"},
    "location": {"id": "whole", "name": "text/1/256", "locality?": "text?/1/256", "coordinates": "point", "isMonitor": "flag", "sensors": "list/1/32/sensor"},
    "point": {"latitude": "number/-90/90", "longitude": "number/-180/180"},
    "sensor": {"id": "whole", "parameter": "parameter"},
    "parameter": {"name": "text/1/64", "units": "text/1/32", "displayName": "text/1/64"},
    "hours": {"results": "list/0/10000/hour"},
    "hour": {"value": "number", "period": "period"},
    "period": {"datetimeTo": "end"},
    "end": {"utc": "instant"},
}
CONTRACT = Contract(RECORDS, "bundle", 5 * 1024 * 1024, depth=8, strict=False)


def read_air(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of the bundles under ``path``: reference monitors with a PM2.5 sensor."""
    return parse_air(spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path))


def _measures(parameter: str):
    return lambda sensor: sensor["parameter"]["name"] == parameter


def air_findings(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, code, path, detail): what is wrong with each bundle (doc_id and JSON text); a sound one has no row.

    Beside the faults of single values: too-many-measurements (of the whole bundle), late-measurement (the first) and
    wrong-unit (of the sensors of monitors that are read).
    """
    small = F.when(F.octet_length(body) <= CONTRACT.max_bytes, F.col(body))
    parsed = payloads.where(F.try_parse_json(small).isNotNull()).select("doc_id", F.from_json(small, SCHEMA).alias("p")).select("doc_id", "p.*")
    hours = F.flatten(F.transform(F.map_values("hours"), lambda h: h["results"]))
    late = F.try_element_at(F.filter(hours, lambda h: h["period"]["datetimeTo"]["utc"].try_cast("timestamp") > F.col("retrievedAt").try_cast("timestamp")), F.lit(1))
    faults = [
        F.when(F.size(hours) > MAX_MEASUREMENTS, finding("too-many-measurements", F.lit("$.hours"), F.size(hours))),
        F.when(late.isNotNull(), finding("late-measurement", F.lit("$.hours"), late["period"]["datetimeTo"]["utc"])),
    ]
    first = lambda place, parameter: F.try_element_at(F.filter(place["sensors"], _measures(parameter)), F.lit(1))
    primary = PARAMETERS["primary"][0]
    read = F.filter("locations.results", lambda x: x["isMonitor"] & first(x, primary).isNotNull())
    for parameter, unit in PARAMETERS.values():
        wrong = F.try_element_at(F.filter(F.transform(read, lambda x: first(x, parameter)), lambda s: s["parameter"]["units"] != unit), F.lit(1))
        faults.append(F.when(wrong.isNotNull(), finding("wrong-unit", F.lit("$.locations.results"), F.concat_ws(" ", wrong["parameter"]["name"], wrong["parameter"]["units"]))))
    return CONTRACT.unread(payloads, body).unionByName(CONTRACT.shape_findings(CONTRACT.rows(payloads, body))).unionByName(findings(parsed, *faults))


def air_stations(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of sound bundles, given as texts."""
    return parse_air(payloads.select(F.from_json(body, SCHEMA).alias("p")).select("p.*"))


def parse_air(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    measured = F.aggregate(F.map_values("hours"), F.lit(0), lambda n, h: n + F.greatest(F.size(h["results"]), F.lit(0)))
    for many, what in ((measured > MAX_MEASUREMENTS, "measurements"), (F.size("locations.results") > MAX_LOCATIONS, "locations")):
        bundles = bundles.where(F.when(F.coalesce(many, F.lit(False)), F.raise_error(F.lit(f"air payload: too many {what}")).cast("boolean")).otherwise(True))
    places = bundles.select("retrievedAt", "hours", F.explode("locations.results").alias("l")).where("l.isMonitor")
    for slot, (parameter, unit) in PARAMETERS.items():
        found = F.try_element_at(F.filter("l.sensors", _measures(parameter)), F.lit(1))
        wrong = found.isNotNull() & (found["parameter"]["units"] != unit)
        places = places.withColumn(slot, F.when(wrong, F.raise_error(F.lit(f"air payload: {parameter} must use {unit}")).cast("bigint")).otherwise(found["id"]))
    places = places.where("primary IS NOT NULL")
    stations = places.select(
        F.col("l.id").cast("string").alias("site_id"), F.col("l.name").alias("name"), F.coalesce("l.locality", "l.name").alias("group"), F.col("l.coordinates.latitude").alias("latitude"),
        F.col("l.coordinates.longitude").alias("longitude"), F.col("retrievedAt").cast("timestamp").alias("retrieved_at"), F.lit("PM2.5").alias("primary_label"), F.lit("Ozone").alias("secondary_label"),
        F.lit(PARAMETERS["primary"][1]).alias("primary_unit"), F.when(F.col("secondary").isNotNull(), PARAMETERS["secondary"][1]).alias("secondary_unit"),
    )
    sides = F.array(*[F.struct(F.lit(slot).alias("slot"), F.try_element_at("hours", F.col(slot).cast("string")).alias("h")) for slot in PARAMETERS])
    flat = places.select(F.col("l.id").cast("string").alias("site_id"), F.explode(sides).alias("x")).select("site_id", "x.slot", F.posexplode("x.h.results").alias("ordinal", "r"))
    observations = flat.select("site_id", "slot", F.col("r.period.datetimeTo.utc").cast("timestamp").alias("at"), F.col("r.value").alias("value"), "ordinal")
    return stations, observations.where("value >= 0 AND NOT isnan(value) AND value < double('infinity')")
