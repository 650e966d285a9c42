"""Source parsers, station facts and the documents made from them, on small payloads in the sources' formats."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evidence, history, reachability, stations, verification
from tidemark.plans import dashboards
from tidemark.sources.air import read_air
from tidemark.sources.enrollment import enrollment_changes, parse_enrollment
from tidemark.sources.river import read_river
from tidemark.sources.tables import canonical_json, write_canonical

AS_OF = "2026-07-29 12:02:00"


def series(site, name, code, unit, points, no_data=-999999):
    return {
        "sourceInfo": {"siteName": name, "siteCode": [{"value": site}], "geoLocation": {"geogLocation": {"latitude": 38.4, "longitude": -121.5}}},
        "variable": {"variableCode": [{"value": code}], "variableDescription": "d", "unit": {"unitCode": unit}, "noDataValue": no_data},
        "values": [{"value": [{"value": x, "dateTime": t} for t, x in points]}],
    }


DAY = "2026-07-28T12:00:00.000Z"
STAGE = [(DAY, "14.00"), ("2026-07-29T06:00:00.000Z", "14.20"), ("2026-07-29T11:00:00.000Z", "14.50"), ("2026-07-29T12:00:00.000Z", "14.80")]
FALLING = [(DAY, "21.5"), ("2026-07-29T06:00:00.000Z", "21.3"), ("2026-07-29T11:00:00.000Z", "21.1"), ("2026-07-29T12:00:00.000Z", "20.9")]
OLD = [(DAY, "7.20"), ("2026-07-29T03:00:00.000Z", "7.22"), ("2026-07-29T09:00:00.000Z", "7.21")]
FLOW = [("2026-07-29T12:00:00.000Z", "26300")]


@pytest.fixture(scope="module")
def river(spark, tmp_path_factory):
    document = {"value": {"queryInfo": {"note": [{"value": "2026-07-29T12:02:00.000Z", "title": "requestDT"}]}, "timeSeries": [
        series("1", "SACRAMENTO R A FREEPORT CA", "00065", "ft", [("2026-07-29T12:00:00.000Z", "1.0")]),
        series("1", "SACRAMENTO R A FREEPORT CA", "00065", "ft", STAGE),
        series("1", "SACRAMENTO R A FREEPORT CA", "00060", "ft3/s", FLOW),
        series("2", "FEATHER R A NICOLAUS CA", "00065", "ft", FALLING),
        series("2", "FEATHER R A NICOLAUS CA", "00060", "ft3/s", FLOW),
        series("3", "AMERICAN R A H ST CA", "00065", "ft", OLD),
        series("3", "AMERICAN R A H ST CA", "00060", "ft3/s", [(DAY, "-999999"), (DAY, " "), (DAY, "n/a")]),
        series("3", "AMERICAN R A H ST CA", "00010", "deg C", FLOW),
    ]}}
    path = tmp_path_factory.mktemp("river") / "a.json"
    path.write_text(json.dumps(document))
    return read_river(spark, str(path))


def test_river_facts(spark, river):
    places, seen = river
    assert {r.site_id: r.group for r in places.collect()} == {"1": "Sacramento River", "2": "FEATHER River", "3": "American River"}
    m = {r.site_id: r for r in stations.station_metrics(places, seen, AS_OF).collect()}
    assert (m["1"].latest_primary, m["1"].latest_secondary) == (14.8, 26300.0)
    assert [m["1"].change_1h, m["1"].change_6h, m["1"].change_24h] == [0.3, 0.6, 0.8]
    assert [m["2"].change_1h, m["2"].change_6h, m["2"].change_24h] == [-0.2, -0.4, -0.6]
    assert [m["3"].change_1h, m["3"].change_6h, m["3"].change_24h] == [None, -0.01, None]  # nothing within 90 minutes
    assert [(m[k].direction, m[k].freshness) for k in "123"] == [("rising", "fresh"), ("falling", "fresh"), ("unknown", "missing")]
    assert m["3"].issues == ["Water-level reading is more than two hours old", "Streamflow readings are missing"]


def test_river_alerts_ranking_and_sections(spark, river):
    places, seen = river
    metrics = stations.station_metrics(places, seen, AS_OF).cache()
    limits = spark.createDataFrame([("t1", "High", "1", 14.5), ("t2", "Exact", "1", 14.8)], "id string, label string, site_id string, above double")
    found = {r.id: (r.severity, r.detail) for r in stations.alerts(metrics, limits).collect()}
    assert set(found) == {"3-quality-0", "3-quality-1", "t1"}
    assert found["t1"] == ("attention", "Sacramento River is 14.8 ft, above the user threshold of 14.5 ft.")
    clear = stations.alerts(metrics.where("site_id = '1'"), limits.where("id = 't2'")).collect()
    assert [(r.id, r.severity) for r in clear] == [("no-alerts", "info")]
    assert [r.site_id for r in stations.ranked(metrics).collect()] == ["1"]
    claims = [r.claim for r in dashboards.conditions_summary(metrics).orderBy("place").collect()]
    assert claims == ["1 gauge is rising and 1 is falling.", "Sacramento River is the fastest-rising complete gauge over the last hour at +0.3 ft.", "1 gauge needs a freshness or completeness check."]
    assert [r.value for r in dashboards.headline_metrics(metrics).orderBy("place").collect()] == [3, 1, 1, 1]
    assert dashboards.ranking(metrics).first().note == "rising; 6h +0.6 ft"
    assert {r.site_id for r in dashboards.trends(metrics, seen).collect()} == {"1", "2", "3"}
    assert [r.site_id for r in dashboards.select_sites(places, "the American River please").collect()] == ["3"]
    assert dashboards.select_sites(places, "all").count() == 3


def test_river_refuses_bad_payloads(spark, tmp_path):
    late = {"value": {"queryInfo": {"creationTime": DAY}, "timeSeries": [series("1", "X", "00065", "ft", STAGE)]}}
    unit = {"value": {"queryInfo": {"creationTime": "2026-07-30T00:00:00Z"}, "timeSeries": [series("1", "X", "00065", "m", STAGE)]}}
    for name, document in (("late", late), ("unit", unit), ("none", {"value": {"queryInfo": {}, "timeSeries": [series("1", "X", "00065", "ft", STAGE)]}})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(document))
        places, seen = read_river(spark, str(path))
        with pytest.raises(Exception, match="river payload"):
            (seen.collect(), places.collect())


def test_air_bundle(spark, tmp_path):
    def place(i, sensors, monitor=True):
        return {"id": i, "name": f"Place {i}", "locality": None if i == 2 else "Town", "isMonitor": monitor, "coordinates": {"latitude": 1.0, "longitude": 2.0}, "sensors": sensors}

    pm = lambda i: {"id": i, "parameter": {"name": "pm25", "units": "µg/m³", "displayName": "PM2.5"}}
    o3 = {"id": 9, "parameter": {"name": "o3", "units": "ppm", "displayName": "Ozone"}}
    hour = lambda h, x: {"value": x, "period": {"datetimeTo": {"utc": f"2026-08-18T{h:02}:00:00Z"}}}
    bundle = {"retrievedAt": "2026-08-18T12:02:00Z", "locations": {"results": [place(1, [o3, pm(5), pm(6)]), place(2, [pm(7)]), place(3, [o3]), place(4, [pm(8)], False)]},
              "hours": {"5": {"results": [hour(11, 18.1), hour(12, 20.6), hour(10, -1.0)]}, "6": {"results": [hour(12, 99.0)]}, "9": {"results": [hour(12, 0.03)]}}}
    path = tmp_path / "air.json"
    path.write_text(json.dumps(bundle))
    places, seen = read_air(spark, str(path))
    assert {r.site_id: r.group for r in places.collect()} == {"1": "Town", "2": "Place 2"}
    m = {r.site_id: r for r in stations.station_metrics(places, seen, "2026-08-18 12:02:00", stations.AIR).collect()}
    assert (m["1"].latest_primary, m["1"].change_1h, m["1"].direction, m["1"].freshness) == (20.6, 2.5, "rising", "fresh")
    assert m["2"].freshness == "missing" and m["2"].direction == "unknown"
    assert stations.ranked(stations.station_metrics(places, seen, "2026-08-18 12:02:00", stations.AIR), stations.AIR).count() == 0


def test_enrollment_page(spark):
    html = """<div id="enrollment"><table><tr><th></th><th>2024</th><th>2025</th></tr><tr><td>Undergraduate</td><td>22,900</td><td>24,034</td></tr>
      <tr><td><b>Graduate</b></td><td>3,484</td><td>3,599</td></tr><tr><td>Total</td><td>26,384</td><td>27,633</td></tr></table></div><div id="student-demographics">"""
    pages = spark.createDataFrame([(html,)], "html string")
    rows = [r.asDict() for r in enrollment_changes(parse_enrollment(pages)).orderBy("year").collect()]
    assert rows[1] == {"year": 2025, "total": 27633, "undergraduate_share": 87.0, "graduate_share": 13.0, "year_change": 4.7}
    with pytest.raises(Exception, match="don't add up"):
        parse_enrollment(spark.createDataFrame([(html.replace("3,599", "3,598"),)], "html string")).collect()


def test_number_spellings(spark):
    cases = {"27,633": (27633.0, "count"), "4.7%": (4.7, "percent"), "−12": (-12.0, "count"), "16.0 µg/m³": (16.0, "ug_per_m3"), "27 633": (27633.0, "count")}
    refused = ["2 7,633", "1 2 3", "4. 7%", "2,7633", "27.", "$27", "12 ft", "", "1.2.3"]
    df = spark.createDataFrame([(x,) for x in [*cases, *refused]], "x string").select("x", tx.normalise_number(F.col("x")).alias("n"))
    found = {r.x: r.n for r in df.collect()}
    assert {x: (found[x]["value"], found[x]["unit"]) for x in cases} == cases
    assert all(found[x]["failure"] for x in refused)


def test_free_text_gate(spark):
    texts = {"Sacramento at 12.4 ft": (["12.4 ft"], []), "Top 3 in the last 6 hours": ([], []), "twelve feet": (["twelve feet"], []), "at 12.5 now": (["12.5"], []), "Please evacuate": ([], ["evacuate"]), "avoid low-lying roads": ([], ["avoid low-lying roads"]), "coordinating evacuations": ([], [])}
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", tx.measurements(F.col("x")).alias("m"), tx.directives(F.col("x")).alias("d"))
    assert {r.x: (r.m, r.d) for r in df.collect()} == texts


def test_to_fixed_rounds_the_exact_value(spark):
    df = spark.createDataFrame([(1.005,), (14.8 - 14.5,), (-1.005,), (None,)], "x double").select(tx.to_fixed_2("x").alias("y"))
    assert [r.y for r in df.collect()] == [1.0, 0.3, -1.0, None]


def test_routing(spark):
    cases = {"river levels": "domain:river", "Riverside fairground": "unsupported", "air and floods": "domains:river+air", "UCR enrollment": "known-source", "UCR enrollment and ozone": "ambiguous"}
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", tx.route_request(F.col("x")).alias("r"))
    assert {r.x: r.r for r in df.collect()} == cases


def test_merging(spark):
    lists = spark.createDataFrame([("g", s, n, i) for s, ids in enumerate(["abc", "bd"]) for n, i in enumerate(ids)], "`group` string, source int, nth int, id string")
    assert [r.id for r in evidence.round_robin(lists).orderBy("place").collect()] == ["a", "b", "d", "c"]
    members = spark.createDataFrame([("f", "fresh", 5), ("f", "fresh", 3), ("p", "fresh", 5), ("p", None, None), ("s", "stale", 1)], "`group` string, status string, latest_at int")
    assert {r.group: (r.status, r.latest_observation_at) for r in evidence.merged_freshness(members).collect()} == {"f": ("fresh", 3), "p": ("partial", None), "s": ("stale", 1)}
    part = spark.createDataFrame([("x", "summary", "T")], "id string, kind string, title string")
    assert [r.id for r in dashboards.compose([("river", part), ("air", None)]).collect()] == ["river-x", "air-absent"]


def test_verification_reasons(spark):
    body = "Total: 27,633 students".encode()
    docs = spark.createDataFrame([("s", body)], "snapshot_id string, content binary").withColumn("sealed_sha256", F.sha2("content", 256))
    good = docs.first().sealed_sha256
    base = dict(case_id="ok", snapshot_id="s", content_sha256=good, start_byte=7, end_byte=13, extracted_text="27,633", normalisation="1", value=27633.0, unit="count")
    cases = [base, {**base, "case_id": "unknown-snapshot", "snapshot_id": "t"}, {**base, "case_id": "snapshot-identity-mismatch", "content_sha256": "0"}, {**base, "case_id": "locator-out-of-range", "end_byte": 99}, {**base, "case_id": "coordinate-text-mismatch", "start_byte": 8},
             {**base, "case_id": "unsupported-normalization", "normalisation": "2"}, {**base, "case_id": "value-not-in-extracted-text", "value": 1.0}, {**base, "case_id": "unit-not-in-extracted-text", "unit": "percent"}, {**base, "case_id": "malformed-candidate", "end_byte": 3}]
    found = verification.verify(spark.createDataFrame(cases, "case_id string, snapshot_id string, content_sha256 string, start_byte int, end_byte int, extracted_text string, normalisation string, value double, unit string"), docs)
    assert {r.case_id: r.refusal for r in found.collect()} == {c["case_id"]: None if c["case_id"] == "ok" else c["case_id"] for c in cases}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "doc")
    rows = spark.createDataFrame([("d", "t", "one")], "document_id string, tenant string, content string")
    assert history.append_version(path, rows, 0) == 1
    assert history.append_version(path, rows.withColumn("content", F.lit("two")), 1) == 2
    with pytest.raises(history.Conflict):
        history.append_version(path, rows, 1)
    versions = spark.read.parquet(path)
    heads = history.heads(spark.createDataFrame([("d", "t", 2)], "id string, tenant string, head int"), versions)
    assert heads.first().content == "two"
    assert history.corrupted(versions).count() == 0 and history.corrupted(versions.withColumn("content", F.lit("x"))).count() == 2


def test_reachability(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    found = reachability.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.node for r in found.collect()} == {"a", "b", "c"}


def test_canonical_json(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, "x"))], "b int, a struct<z:int,y:string>")
    assert canonical_json(df).first().json == '{"a":{"y":"x","z":2},"b":1}'
    write_canonical(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":{"y":"x","z":2},"b":1}'


def test_enrollment_shares_round_the_exact_binary_value(spark):
    history = spark.createDataFrame([(2000, 3, 1997, 2000), (2001, 5, 1995, 2003)], "year int, undergraduate int, graduate int, total int")
    found = {r.year: r for r in enrollment_changes(history).collect()}
    exact = lambda x: float(f"{x:.1f}")  # noqa: E731  rounds the exact value; there is no tie here
    assert found[2000].undergraduate_share == 0.1 == exact(3 / 2000 * 100) and found[2000].graduate_share == exact(1997 / 2000 * 100)
    assert found[2000].year_change is None and found[2001].year_change == exact(3 / 2000 * 100)


# --- payloads as texts, pages, and whole documents -----------------------------------------------------------------------


def test_files_over_the_limit_are_refused_unread(spark, tmp_path):
    """A file over the limit isn't opened: its content could not even be read here, as it is no UTF-8 and no JSON."""
    from tidemark.sources import river as source
    from tidemark.sources.payloads import read_payloads, sound_payloads

    good = {"value": {"queryInfo": {"creationTime": "2026-07-30T00:00:00Z"}, "timeSeries": [series("11447650", "X R Y", "00065", "ft", STAGE), series("11447650", "X R Y", "00060", "ft3/s", FLOW)]}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_bytes(b"\xff" * (source.CONTRACT.max_bytes + 1))
    (tmp_path / "c.json").write_text("{")
    payloads = read_payloads(spark, str(tmp_path), source.CONTRACT.max_bytes)
    held = {r.doc_id.rsplit("/", 1)[1]: (r.size, r.body) for r in payloads.collect()}
    assert held["b.json"] == (source.CONTRACT.max_bytes + 1, None) and held["c.json"] == (1, "{")
    small = payloads.where(F.col("body").isNotNull())
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length," in payloads._jdf.queryExecution().executedPlan().toString()
    found = source.river_findings(payloads)
    assert {(r.doc_id.rsplit("/", 1)[1], r.code) for r in found.collect()} == {("b.json", "too-large"), ("c.json", "not-json")}
    places, seen = source.river_stations(sound_payloads(small, found))
    assert [r.site_id for r in places.collect()] == ["11447650"] and seen.count() == len(STAGE) + len(FLOW)


def test_river_findings_name_every_fault(spark):
    from tidemark.sources.river import river_findings

    one = series("11447650", "X R Y", "00065", "ft", STAGE)
    document = {"value": {"queryInfo": {"creationTime": "2026-07-30T00:00:00Z"}, "timeSeries": [one]}}

    def changed(**parts):
        out = json.loads(json.dumps(document))
        for path, value in parts.items():
            at, keys = out, path.split("__")
            for k in keys[:-1]:
                at = at[int(k)] if k.isdigit() else at[k]
            at[int(keys[-1]) if keys[-1].isdigit() else keys[-1]] = value
        return json.dumps(out)

    base = "value__timeSeries__0__"
    many = [{"value": "1", "dateTime": DAY}] * 10_001
    cases = {
        "sound": (json.dumps(document), set()),
        "null": (None, {("not-json", "$")}),
        "site": (changed(**{base + "sourceInfo__siteCode__0__value": "12x"}), {("not-digits", "$.value.timeSeries[0].sourceInfo.siteCode[0].value")}),
        "series": (changed(value__timeSeries=[one] * 61), {("too-many", "$.value.timeSeries")}),
        "group": (changed(**{base + "values": [{"value": many}]}), {("too-many", "$.value.timeSeries[0].values[0].value")}),
        "total": (changed(value__timeSeries=[{**one, "values": [{"value": many[:-1]}] * 3}]), {("too-many-observations", "$.value.timeSeries")}),
        "late": (changed(value__queryInfo__creationTime="2026-07-29T11:59:59Z"), {("late-observation", "$.value.timeSeries")}),
        "time": (changed(value__queryInfo={"note": []}), {("no-retrieval-time", "$.value.queryInfo")}),
        "unread unit": (changed(**{base + "variable__variableCode__0__value": "00010", base + "variable__unit__unitCode": "deg C"}), set()),
        "unit": (changed(**{base + "variable__unit__unitCode": "m"}), {("wrong-unit", "$.value.timeSeries[0].variable.unit.unitCode")}),
        "lacking": (changed(**{base + "variable": {}}), {("missing-field", f"$.value.timeSeries[0].variable.{f}") for f in ("variableCode", "variableDescription", "unit", "noDataValue")}),
    }
    found = river_findings(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "doc_id string, body string")).collect()
    assert {k: {(r.code, r.path) for r in found if r.doc_id == k} for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_enrollment_findings_of_many_pages(spark):
    from tidemark.sources.enrollment import DEFINITION, enrollment_findings, enrollment_history

    def page(years=("2024", "2025"), under=("22,900", "24,034"), grad=("3,484", "3,599"), total=("26,384", "27,633"), term="2025", prose="27,633 students, 24,034 (87.0%) and 3,599 (13.0%)", more=""):
        row = lambda head, cells: f"<tr><td>{head}</td>{''.join(f'<td><b>{c}</b></td>' for c in cells)}</tr>"
        table = row("", years) + row("Undergraduate Enrollment", under) + row("Graduate Enrollment", grad) + row("Total Enrollment", total) + more
        return f'x<div id="enrollment"><h4>Enrollment - Fall {term}</h4><h5> Overview </h5><p>In the Fall {term} term, {prose}.</p><table>{table}</table><p>{DEFINITION}</p></div><div id="student-demographics">'

    pages = {
        1: (page(), set()), 2: (None, {("no-section", None)}), 3: ("", {("no-section", None)}), 4: ("y" * 1_000_001, {("too-large", None)}),
        5: (page(prose="27,634 students, 24,034 (87.0%) and 3,599 (13.1%)"), {("overview-figure", "27,633"), ("overview-figure", "13.0%")}),
        6: (page(years=("2025", "2024"), term="2024", prose="27,633 students, 24,034 (87.0%) and 3,599 (13.0%)"), {("years-fall", "2024")}),
        7: (page(total=("26,384", "27,63x"), prose="24,034 and 3,599"), {("bad-number", "27,63x")}),
        8: (page(years=("2025",), under=("24,034",), grad=("3,599",), total=("27,633",)), {("few-years", None)}),
        9: (page(more="<tr><td>Total Enrollment</td><td>26,384</td><td>27,633</td></tr>"), {("row-count", "5"), ("repeated-row", "Total Enrollment")}),
        10: (page().replace(DEFINITION, "").replace("<h4>", "<h3>"), {("no-definition", None), ("no-heading", None)}),
        11: (page(term="2026"), {("heading-year", "2025")}),
    }
    table = spark.createDataFrame([(k, v) for k, (v, _) in pages.items()], "page_id int, html string")
    found = enrollment_findings(table)
    assert {k: {(r.problem, r.subject) for r in found.collect() if r.page_id == k} for k in pages} == {k: v for k, (_, v) in pages.items()}
    rows = enrollment_changes(enrollment_history(table, found), "page_id").orderBy("year").collect()
    assert [(r.page_id, r.year, r.total, r.year_change) for r in rows] == [(1, 2024, 26384, None), (1, 2025, 27633, 4.7)]


def test_air_findings(spark):
    from tidemark.sources.air import air_findings

    sensor = lambda i, name, unit: {"id": i, "parameter": {"name": name, "units": unit, "displayName": name}}
    place = lambda sensors, monitor=True: {"id": 1, "name": "P", "locality": None, "isMonitor": monitor, "coordinates": {"latitude": 1.0, "longitude": 2.0}, "sensors": sensors}
    bundle = lambda places, hours: json.dumps({"retrievedAt": "2026-08-18T12:02:00Z", "locations": {"results": places}, "hours": hours})
    hour = {"value": 1.0, "period": {"datetimeTo": {"utc": "2026-08-18T12:00:00Z"}}}
    good = [sensor(5, "pm25", "µg/m³"), sensor(9, "o3", "ppm")]
    cases = {
        "sound": (bundle([place(good)], {"5": {"results": [hour]}}), set()),
        "unread": (bundle([place([sensor(5, "pm25", "ppm")], False), place([sensor(5, "o3", "x")])], {}), set()),
        "unit": (bundle([place([sensor(5, "pm25", "µg/m³"), sensor(9, "o3", "ppb")])], {}), {"wrong-unit"}),
        "late": (bundle([place(good)], {"5": {"results": [{"value": 1.0, "period": {"datetimeTo": {"utc": "2026-08-18T13:00:00Z"}}}]}}), {"late-measurement"}),
        "many": (bundle([place(good)], {str(k): {"results": [hour] * 10_000} for k in (5, 6)} | {"7": {"results": [hour]}}), {"too-many-measurements"}),
        "key": (bundle([place(good)], {"a": {"results": []}}), {"not-digits"}),
        "id": (bundle([{**place(good), "id": 0}], {}), {"out-of-range"}),
        "flag": (bundle([{**place(good), "isMonitor": "yes"}], {}), {"wrong-type"}),
        "none": (bundle([], {}), {"too-few"}),
    }
    found = air_findings(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "doc_id string, body string")).collect()
    assert {k: {r.code for r in found if r.doc_id == k} for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_reachability_along_a_long_path(spark):
    """Many rounds: what is known stays in few tables."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(5, 2), (40, 41)], "src int, dst int")
    found = reachability.reachable(edges, spark.createDataFrame([(0,), (0,)], "node int"))
    assert sorted(r.node for r in found.collect()) == list(range(12))


def test_relations_are_followed_around_cycles(spark):
    from tidemark.operators.reachability import reachable_relations

    table = lambda rows: spark.createDataFrame(rows, "src bigint, dst bigint")
    chain = [(i, i + 1) for i in range(12)] + [(12, 0), (40, 41)]
    edges = [("a", "b", [(1, 10), (1, 11), (2, 99), (3, None)]), ("b", "a", [(10, 3), (11, 1)]), ("b", "c", [(10, 0), (11, 40), (None, 7)]), ("c", "c", chain), ("a", "c", [(3, 5)])]
    found = reachable_relations([(x, y, table(rows)) for x, y, rows in edges], {"a": spark.createDataFrame([(1,), (1,)], "node bigint")}).collect()
    reached, todo = set(), [("a", 1)]
    while todo:
        kind, node = todo.pop()
        if (kind, node) not in reached:
            reached.add((kind, node))
            todo += [(y, d) for x, y, rows in edges for s, d in rows if x == kind and s == node and node is not None]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, reached)) and ("b", None) in reached and len(reached) == 20
