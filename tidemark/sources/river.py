"""River gauge readings from WaterML-style JSON documents, one document a file or a text.

``river_findings`` names what is wrong with which payload, and ``parse_river`` reads sound ones; ``read_river`` fails at the
first unsound payload instead. Nothing here shuffles readings: which of two series of a site and slot counts is settled
within the document that holds both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import river_group
from tidemark.sources.shapes import Contract, finding, findings

SCHEMA = """
  value struct<
    queryInfo: struct<creationTime: string, note: array<struct<value: string, title: string>>>,
    timeSeries: array<struct<
      sourceInfo: struct<siteName: string, siteCode: array<struct<value: string>>, geoLocation: struct<geogLocation: struct<latitude: double, longitude: double>>>,
      variable: struct<variableCode: array<struct<value: string>>, variableDescription: string, unit: struct<unitCode: string>, noDataValue: double>,
      values: array<struct<value: array<struct<value: string, dateTime: string>>>>>>>
"""
# Parameter codes, their slot and the unit they must have; the limits of one document.
PARAMETERS = {"00065": ("primary", "ft"), "00060": ("secondary", "ft3/s")}
MAX_SERIES, MAX_OBSERVATIONS = 60, 20_000
RECORDS = {
    "payload": {"value": "response"},
    "response": {"queryInfo": "info", "timeSeries": f"list/1/{MAX_SERIES}/series"},
    "info": {"creationTime?": "instant", "note?": "list/0/16/note"},
    "note": {"value": "text/0/512", "title?": "text/0/64"},
    "series": {"sourceInfo": "source", "variable": "variable", "values": "list/1/4/group"},
    "source": {"siteName": "text/1/256", "siteCode": "list/1/4/site", "geoLocation": "geo"},
    "site": {"value": "digits/8/15"},
    "geo": {"geogLocation": "point"},
    "point": {"latitude": "number/-90/90", "longitude": "number/-180/180"},
    "variable": {"variableCode": "list/1/4/code", "variableDescription": "text/1/512", "unit": "unit", "noDataValue": "number"},
    "code": {"value": "text/1/64"},
    "unit": {"unitCode": "text/1/32"},
    "group": {"value": "list/0/10000/reading-text"},
    "reading-text": {"value": "text/0/128", "dateTime": "instant"},
}
CONTRACT = Contract(RECORDS, "payload", 5 * 1024 * 1024, depth=9, strict=False)


def _fail(condition, message: str, value):
    return F.when(condition, F.raise_error(F.lit(f"river payload: {message}")).cast("string")).otherwise(value)


def _retrieved(info: Column) -> Column:
    titled = F.filter(info["note"], lambda n: n["title"] == "requestDT")
    return F.coalesce(info["creationTime"], F.try_element_at(titled, F.lit(1))["value"]).try_cast("timestamp")


def _code(series: Column) -> Column:
    return series["variable"]["variableCode"][0]["value"]


def _readings(series: Column) -> Column:
    return F.flatten(F.transform(series["values"], lambda group: group["value"]))


def river_findings(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, code, path, detail): what is wrong with each payload (doc_id and JSON text); a sound one has no row.

    Beside the faults of single values: no-retrieval-time, too-many-observations (of the whole payload), wrong-unit (of a
    series that is read) and late-observation (the first of a payload that is later than its retrieval).
    """
    rows = CONTRACT.rows(payloads, body)
    small = F.when(F.octet_length(body) <= CONTRACT.max_bytes, F.col(body))
    parsed = payloads.where(F.try_parse_json(small).isNotNull()).select("doc_id", F.from_json(small, SCHEMA).alias("p")).select("doc_id", F.col("p.value.timeSeries").alias("series"), _retrieved(F.col("p.value.queryInfo")).alias("retrieved_at"))
    total = F.aggregate("series", F.lit(0), lambda n, s: n + F.greatest(F.size(_readings(s)), F.lit(0)))
    wanted = F.create_map(*[F.lit(x) for c, (_, u) in PARAMETERS.items() for x in (c, u)])
    units = F.transform("series", lambda s, i: F.struct(i.alias("i"), s["variable"]["unit"]["unitCode"].alias("unit"), F.try_element_at(wanted, _code(s)).alias("wanted")))
    wrong = F.try_element_at(F.filter(units, lambda u: u["unit"] != u["wanted"]), F.lit(1))
    times = F.flatten(F.transform("series", lambda s: F.transform(_readings(s), lambda r: r["dateTime"])))
    late = F.try_element_at(F.filter(times, lambda t: t.try_cast("timestamp") > F.col("retrieved_at")), F.lit(1))
    whole = findings(
        parsed,
        F.when(F.col("retrieved_at").isNull(), finding("no-retrieval-time", F.lit("$.value.queryInfo"))),
        F.when(total > MAX_OBSERVATIONS, finding("too-many-observations", F.lit("$.value.timeSeries"), total)),
        F.when(wrong.isNotNull(), finding("wrong-unit", F.concat(F.lit("$.value.timeSeries["), wrong["i"].cast("string"), F.lit("].variable.unit.unitCode")), wrong["unit"])),
        F.when(late.isNotNull(), finding("late-observation", F.lit("$.value.timeSeries"), late)),
    )
    return CONTRACT.unread(payloads, body).unionByName(CONTRACT.shape_findings(rows)).unionByName(whole)


def river_stations(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of sound payloads, given as texts."""
    return parse_river(payloads.select(F.from_json(body, SCHEMA).alias("p")).select("p.*"))


def read_river(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of the documents under ``path``; of one site and slot in a document the later series wins."""
    return parse_river(spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path))


def parse_river(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = documents.select(F.monotonically_increasing_id().alias("document"), _retrieved(F.col("value.queryInfo")).alias("retrieved_at"), F.col("value.timeSeries").alias("series"))
    rows = rows.withColumn("retrieved_at", _fail(F.col("retrieved_at").isNull(), "no retrieval time", F.col("retrieved_at").cast("string")).cast("timestamp"))
    readings = F.aggregate("series", F.lit(0), lambda n, s: n + F.coalesce(F.aggregate(s["values"], F.lit(0), lambda m, v: m + F.greatest(F.size(v["value"]), F.lit(0))), F.lit(0)))
    few = _fail(readings > MAX_OBSERVATIONS, "too many observations", F.lit("ok"))
    rows = rows.withColumn("checked", _fail(F.size("series") > MAX_SERIES, "too many time series", few))
    # Of the series of a site and code the last counts; a document has few series.
    same = lambda s, t: (s["sourceInfo"]["siteCode"][0]["value"] == t["sourceInfo"]["siteCode"][0]["value"]) & (_code(s) == _code(t))
    last = F.transform("series", lambda s, i: F.struct(s.alias("s"), (~F.exists(F.slice("series", i + 2, F.size("series")), lambda t: same(s, t))).alias("last")))
    series = rows.select("document", "retrieved_at", "checked", F.posexplode(last).alias("nth", "x")).where("checked = 'ok'").select("document", "retrieved_at", "nth", "x.*")
    code, unit = _code(F.col("s")), F.col("s.variable.unit.unitCode")
    wanted = F.create_map(*[F.lit(x) for c, (_, u) in PARAMETERS.items() for x in (c, u)])
    slots = F.create_map(*[F.lit(x) for c, (slot, _) in PARAMETERS.items() for x in (c, slot)])
    series = series.where(code.isin(*PARAMETERS)).select(
        "document", "retrieved_at", "nth", F.col("s.sourceInfo.siteCode")[0]["value"].alias("site_id"), F.col("s.sourceInfo.siteName").alias("name"),
        F.col("s.sourceInfo.geoLocation.geogLocation.latitude").alias("latitude"), F.col("s.sourceInfo.geoLocation.geogLocation.longitude").alias("longitude"),
        slots[code].alias("slot"), _fail(unit != wanted[code], "unit", unit).alias("unit"), F.col("s.variable.noDataValue").alias("no_data"), "last", _readings(F.col("s")).alias("readings"),
    )
    first = F.min_by(F.struct("name", "latitude", "longitude", "retrieved_at"), F.struct("document", "nth")).alias("f")
    units = [F.max(F.when(F.col("slot") == slot, F.col("unit"))).alias(f"{slot}_unit") for slot in ("primary", "secondary")]
    stations = series.groupBy("site_id").agg(first, *units)
    stations = stations.select("site_id", "f.name", river_group(F.col("f.name")).alias("group"), "f.latitude", "f.longitude", "f.retrieved_at", F.lit("Water-level").alias("primary_label"), F.lit("Streamflow").alias("secondary_label"), "primary_unit", "secondary_unit")
    flat = series.where("last").select("site_id", "slot", "no_data", "retrieved_at", F.posexplode("readings").alias("ordinal", "r"))
    at, value = F.col("r.dateTime").cast("timestamp"), F.expr("try_cast(trim(r.value) AS double)")
    flat = flat.withColumn("at", _fail(at > F.col("retrieved_at"), "an observation is later than its retrieval", at.cast("string")).cast("timestamp")).withColumn("value", value)
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & (F.col("value") != F.col("no_data"))
    return stations, flat.where(sound).select("site_id", "slot", "at", "value", "ordinal")
