"""Whole documents: composition and the contract, beside what the registered queries show."""

import json

from pyspark.sql import functions as F

from tidemark.plans import documents
from tidemark.plans.documents import DOCUMENT, compose_documents, contract_findings, document_json


def source(station, title="Overview", mode="live", made="2026-08-19T12:00:00.000Z", status="fresh", latest="2026-08-19T11:00:00.000Z", citations=0, types=("observed",)):
    ids = ["reading", *[f"more-{i}" for i in range(citations)]]
    cite = {"evidenceIds": ids}
    measured = {"value": 3.5, "unit": "ft"}
    table = {"kind": "station-table", "id": "table", "title": "Now", "stations": [{"id": station, "name": "n", "group": "g", "latitude": 1.0, "longitude": 2.0, "primary": measured, "secondary": {"value": None, "unit": "cfs"}, "direction": "rising", "freshness": "fresh", "evidenceIds": ["reading"]}],
             "columns": {"station": "S", "primary": "P", "secondary": "Q"}, **cite}
    summary = {"kind": "summary", "id": "summary", "title": "S", "tone": "normal", "claims": [{"text": "It rose", "evidenceIds": ["reading"]}], "evidenceIds": ["reading"]}
    statement = lambda text: {"statementTypes": list(types), "headline": text, "detail": text, **cite}
    return {
        "schemaVersion": "1.2", "id": "d", "title": title, "audience": "a", "generatedAt": made, "dataMode": mode, "freshness": {"status": status, "label": "l", **({"latestObservationAt": latest} if latest else {})},
        "nextAction": {"title": "t", "detail": "Look", **cite}, "notice": "n", "pages": [{"id": "overview", "title": title, "description": "d", "components": [summary, table]}],
        "evidence": [{"id": i, "kind": "observed", "label": "l", "sourceName": "s", "retrievedAt": "2026-08-19T10:00:00Z", "detail": "d", "confidence": "high"} for i in ids],
        "architecture": {"title": "t", "summary": "Reads.", "nodes": [{"id": i, "label": i, "detail": i, "kind": "input"} for i in ("in", "out")], "edges": [{"from": "in", "to": "out", "label": "builds"}]},
        "executiveBrief": {k: statement(f"{k} text") for k in ("known", "changed", "important")},
    }


def composed(spark, *cases):
    """Each case is a list of (key, label, document or None)."""
    rows = [(i, p, k, label, json.dumps(d) if d else None) for i, case in enumerate(cases) for p, (k, label, d) in enumerate(case)]
    members = spark.createDataFrame(rows, "request_id int, place int, key string, label string, body string").withColumn("dashboard", F.from_json("body", DOCUMENT)).drop("body")
    requests = spark.createDataFrame([(i, f"r{i}", "Both", "a", "n") for i in range(len(cases))], "request_id int, id string, title string, audience string, notice string")
    return {r.request_id: r for r in compose_documents(members, requests).collect()}


def test_composition(spark):
    river, air = source("1"), source("2", latest="2026-08-19T10:30:00+00:00", made="2026-08-19T14:00:00+01:00", types=("calculated", "interpreted"))
    many = [(k, k.title(), source(k, citations=19)) for k in ("river", "air", "tide")]
    cases = [
        [("river", "River", river), ("air", "Air", air)],
        many,
        [("river", "River", None), ("air", "Air", air)],
        [("river", "River", river)],
        [*many, ("four", "Four", river)],
        [("river", "River", None), ("air", "Air", None)],
        [("a", "A", river), ("b", "B", river), ("b", "B", air)],
        [("a", "A", river), ("b", "B", source("3", mode="demo"))],
        [("a", "A", river), ("b", "B", source("3", status="stale", latest=None))],
        [],
        [("k" * 125, "A", river), ("b", "B", air)],  # ids grow beyond what the contract allows
    ]
    found = composed(spark, *cases)
    assert [found[i].refusal for i in range(len(cases))] == [None, None, None, "too-few-sources", "too-many-sources", "none-loaded", "repeated-key", "mixed-modes", None, "too-few-sources", "breaks-contract"]
    assert [found[i].dashboard is None for i in range(len(cases))] == [f.refusal is not None for _, f in sorted(found.items())]
    d = found[0].dashboard
    assert [p.id for p in d.pages] == ["river:overview", "air:overview"] and [p.title for p in d.pages] == ["River — Overview", "Air — Overview"]
    assert [s.id for p in d.pages for c in p.components for s in c.stations or []] == ["1", "2"]
    assert [(c.id, c.title, c.evidenceIds) for c in d.pages[1].components] == [("air:summary", "S", ["air:reading"]), ("air:table", "Now", ["air:reading"])]
    assert (d.generatedAt, d.freshness.status, d.freshness.latestObservationAt) == ("2026-08-19T14:00:00+01:00", "fresh", "2026-08-19T10:30:00+00:00")
    assert d.executiveBrief.known.statementTypes == ["calculated", "interpreted"] and d.executiveBrief.known.headline == "River: known text · Air: known text"
    assert d.nextAction.detail == "River: Look. Air: Look" and d.architecture.summary == "River: Reads. Air: Reads."
    cited = found[1].dashboard.executiveBrief.known.evidenceIds
    assert len(cited) == documents.MAX_CITED == len(set(cited)) and min(sum(x.startswith(k + ":") for x in cited) for k in ("river", "air", "tide")) >= 10
    absent = found[2].dashboard
    assert (absent.freshness.status, absent.freshness.latestObservationAt, absent.freshness.label) == ("partial", None, "River: unavailable · Air: l")
    assert absent.nextAction.detail == "River: unavailable when this dashboard was built. Air: Look" and len(absent.pages) == 1
    assert (found[8].dashboard.freshness.status, found[8].dashboard.freshness.latestObservationAt) == ("partial", None)


def test_contract_of_json_in_many_shapes(spark):
    good = source("1")
    change = lambda f: (lambda d: (f(d), d)[1])(json.loads(json.dumps(good)))
    cases = {
        "sound": (json.dumps(good), set()),
        "null": (None, {("not-json", "$")}),
        "empty": ("", {("not-json", "$")}),
        "list": ("[]", {("wrong-type", "$")}),
        "number": ("1", {("wrong-type", "$")}),
        "bare": ("{}", {("missing-field", f"$.{f}") for f in documents.RECORDS["dashboard"]}),
        "repeated key": (json.dumps(good).replace('"notice": "n"', '"notice": "n", "notice": "m"'), {("not-json", "$")}),
        "no kind": (json.dumps(change(lambda d: d["pages"][0]["components"][0].pop("kind"))), {("missing-field", "$.pages[0].components[0].kind")}),
        "null reading": (json.dumps(change(lambda d: d["pages"][0]["components"][1]["stations"][0]["primary"].pop("value"))), {("missing-field", "$.pages[0].components[1].stations[0].primary.value")}),
        "null optional": (json.dumps(change(lambda d: d["evidence"][0].update(observedAt=None))), {("wrong-type", "$.evidence[0].observedAt")}),
        "dangling": (json.dumps(change(lambda d: d["pages"][0]["components"][0]["claims"][0].update(evidenceIds=["x", "reading"]))), {("missing-evidence", "$.pages[0].components[0].claims[0].evidenceIds[0]")}),
    }
    rows = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "doc_id string, body string")
    found = contract_findings(rows).collect()
    assert {k: {(r.code, r.path) for r in found if r.doc_id == k} for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_document_json_keeps_null_readings(spark):
    row = spark.createDataFrame([(json.dumps(source('a "primary":{"unit"')),)], "body string").select(F.from_json("body", DOCUMENT).alias("d"))
    text = row.select(document_json(F.col("d")).alias("j")).first().j
    stations = json.loads(text)["pages"][0]["components"][1]["stations"]
    assert stations[0]["secondary"] == {"value": None, "unit": "cfs"} and stations[0]["id"] == 'a "primary":{"unit"'
    assert contract_findings(row.select(F.lit(1).alias("doc_id"), document_json(F.col("d")).alias("body"))).count() == 0


def test_compiled_plans(spark):
    """Ties in the plan's order, thresholds in theirs, unknown sites and sections left out; and a plan without stations."""
    from tidemark.plans.compiled import compile_documents

    def station(site, change, freshness="fresh", issues=(), level=10.0):
        return (site, f"Name {site}", f"River {site}", 1.0, 2.0, "Level", "Flow", "ft", "ft3/s", "Survey", "2026-07-29 11:00:00", level, 5.0, "2026-07-29 10:00:00", change, change, None, "rising" if change > 0.05 else "steady", freshness, freshness, list(issues))

    kinds = "site_id string, name string, `group` string, latitude double, longitude double, primary_label string, secondary_label string, primary_unit string, secondary_unit string, source_name string, retrieved string, latest_primary double, latest_secondary double, latest string, change_1h double, change_6h double, change_24h double, direction string, freshness string, primary_freshness string, issues array<string>"
    rows = [station("a", 0.2), station("b", 0.4), station("c", 0.4), station("d", 0.9, "stale", ["Level reading is more than two hours old"]), station("e", 0.01)]
    metrics = spark.createDataFrame(rows, kinds).withColumn("retrieved_at", F.col("retrieved").cast("timestamp")).withColumn("latest_at", F.col("latest").cast("timestamp"))
    page = lambda i, *sections: {"id": i, "title": i, "description": i, "sections": list(sections)}
    plans = [
        (1, "T", "A", "F", ["c", "x", "a", "b", "d"], [page("one", "fastest-rising", "nonsense", "stage-trends"), page("two", "nonsense"), page("three", "attention", "gauge-map")]),
        (2, "T", "A", "F", ["e", "a"], [page("one", "attention", "conditions-summary")]),
        (3, "T", "A", "F", ["x"], [page("one", "headline-metrics", "gauge-map")]),
    ]
    table = spark.createDataFrame(plans, "plan_id int, title string, audience string, framing string, site_ids array<string>, pages array<struct<id:string,title:string,description:string,sections:array<string>>>")
    limits = spark.createDataFrame([(1, "t1", "High", "b", 9.0), (0, "t0", "High", "c", 9.0), (2, "t2", "High", "a", 10.0), (3, "t3", "High", "d", 1.0)], "nth int, id string, label string, site_id string, above double")
    made = compile_documents(table, metrics, "2026-07-29 12:00:00", thresholds=limits)
    found = {r.plan_id: r.dashboard for r in made.collect()}
    one = found[1]
    assert [(p.id, [c.id for c in p.components]) for p in one.pages] == [("one", ["fastest-rising"]), ("three", ["attention", "gauge-map"])]
    assert [(i.id, i.value) for i in one.pages[0].components[0]["items"]] == [("c", "+0.4 ft"), ("b", "+0.4 ft"), ("a", "+0.2 ft")]
    assert [a.id for a in one.pages[1].components[0].alerts] == ["d-quality-0", "t0", "t1"]
    assert one.nextAction.detail == "Name d: Level reading is more than two hours old" and one.executiveBrief.changed.headline == "River c rose fastest"
    assert one.executiveBrief.important.detail.startswith("Highest priority: River d — ") and one.executiveBrief.important.headline == "3 items need attention"
    assert (one.freshness.status, one.freshness.label, one.freshness.latestObservationAt) == ("partial", "1 gauge needs attention", "2026-07-29T10:00:00.000Z")
    two = found[2]
    assert [a.id for a in two.pages[0].components[0].alerts] == ["no-alerts"] and two.nextAction.title == "Review the dashboard before sharing"
    assert [c.text for c in two.pages[0].components[1].claims] == ["1 gauge is rising and 0 are falling.", "River a is the fastest-rising complete gauge over the last hour at +0.2 ft.", "All selected gauges are fresh and complete."]
    told = contract_findings(made.select(F.col("plan_id").alias("doc_id"), document_json(F.col("dashboard")).alias("body"))).collect()
    assert {r.doc_id for r in told} == {3} and ("too-few", "$.pages[0].components[1].stations") in {(r.code, r.path) for r in told}


def _tied_pages(spark, tmp_path):
    """Pages whose undergraduate share lies just between two tenths, on which quotients of doubles and of decimals differ."""
    rows = [(i, "") for i in (8082, 16920, 24824, 51767)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_printed_shares_at_ties(spark, tmp_path):
    from tidemark import document_queries

    assert document_queries.enrollment_page_findings(spark, _tied_pages(spark, tmp_path)).collect() == []


def test_shares_and_changes_at_ties(spark, tmp_path):
    import duckdb

    from tidemark import document_queries, registry

    folder = _tied_pages(spark, tmp_path)
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    wanted = duckdb.sql(registry.SQL["enrollment_page_history"]).fetchall()
    assert sorted(map(tuple, document_queries.enrollment_page_history(spark, folder).collect())) == sorted(wanted) and len(wanted) == 12


def test_changes_that_fall_and_totals_of_zero(spark):
    from tidemark.sources.enrollment import enrollment_changes

    rows = [(2021, 1, 7, 8), (2022, 0, 7, 7), (2023, 0, 0, 0), (2024, 1, 0, 1)]
    history = spark.createDataFrame(rows, "year int, undergraduate bigint, graduate bigint, total bigint")
    found = [tuple(r)[2:] for r in enrollment_changes(history).orderBy("year").collect()]
    assert found == [(12.5, 87.5, None), (0.0, 100.0, -12.5), (None, None, -100.0), (100.0, 0.0, None)]


def test_sound_documents_are_judged_in_their_row(spark):
    """No text that just repeats the struct is taken apart if it is sound, and none with a finding is taken for sound."""
    from tidemark.plans.documents import surely_sound

    texts = spark.createDataFrame([(json.dumps(source(str(i), citations=i)),) for i in range(3)], "body string").select(document_json(F.from_json("body", DOCUMENT)).alias("body"))
    good = [r.body for r in texts.collect()]
    one = good[1]
    changes = [
        ('"title":"t"', '"title":"t","title":"t"'), ('"latitude":1.0', '"latitude":"NaN"'), ('"latitude":1.0', '"latitude":1e400'), ('"label":"l"', '"label":""'), ('"evidenceIds":["reading"', '"evidenceIds":[null,"reading"'),
        ('"tone":"normal"', '"tone":"normal","items":[]'), ('"unit":"ft"', '"unit":""'), ('"kind":"summary"', '"kind":"ranking"'), ('"observed"', '"observed","observed"'), ('"id":"more-0"', '"id":"reading"'), ('"direction":"rising"', '"direction":"up"'),
        ('"confidence":"high"}', '"confidence":"high","observedAt":"2026-08-19T10:00:01Z"}'), ('"from":"in"', '"from":"no"'), ('"latestObservationAt":"2026-08-19T11:00:00.000Z"', '"latestObservationAt":"2026-08-19T12:00:00.001Z"'), ("}}", "}} "),
    ]
    assert all(a in one for a, _ in changes)
    rows = spark.createDataFrame(enumerate([*good, *[one.replace(a, b, 1) for a, b in changes], None, ""]), "doc_id int, body string").cache()
    sound = {r.doc_id for r in rows.where(surely_sound(F.col("body"))).collect()}
    found = {r.doc_id for r in contract_findings(rows).collect()}
    assert sound == {0, 1, 2} and found == set(range(3, 5 + len(changes))) - {2 + len(changes)}  # a blank at the end is sound


def test_requests_are_composed_and_judged_in_their_row(spark):
    """No job runs while a composition is declared, so that no document is made twice; members may come with their request."""
    cases = [[("a", "A", source("1")), ("b", "B", source("2"))], [("k" * 125, "A", source("1")), ("b", "B", source("2"))], [("a", "A", None), ("b", "B", source("2"))], []]
    rows = [(i, p, k, label, json.dumps(d) if d else None) for i, case in enumerate(cases) for p, (k, label, d) in enumerate(case)]
    members = spark.createDataFrame(rows, "request_id int, place int, key string, label string, body string").withColumn("dashboard", F.from_json("body", DOCUMENT)).drop("body")
    requests = spark.createDataFrame([(i, "r", "Both", "a", "n") for i in range(len(cases))], "request_id int, id string, title string, audience string, notice string")
    context = spark.sparkContext
    context.setJobGroup("declared", "a composition that nothing reads yet")
    made = compose_documents(members, requests)
    jobs = list(context.statusTracker().getJobIdsForGroup("declared"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == []
    held = members.groupBy("request_id").agg(F.collect_list(F.struct("place", "key", "label", "dashboard")).alias("members"))
    gathered = documents.compose_gathered(requests.join(held.withColumn("members", F.reverse("members")), "request_id", "left"))
    found = sorted(made.collect())
    assert [r.refusal for r in found] == [None, "breaks-contract", None, "too-few-sources"] and sorted(gathered.collect()) == found


def test_structs_are_judged_as_their_text(spark):
    """keeps_contract tells of structs what contract_findings does of their JSON text, at limits and of bytes that aren't UTF-8."""
    text = lambda f: json.dumps((f(d := source("1", citations=2)), d)[1])
    retitled = lambda t: text(lambda d: d.update(title=t))
    seen = lambda *times: text(lambda d: [e.update(observedAt=t) for e, t in zip(d["evidence"], times)])
    linked = lambda url: text(lambda d: d["evidence"][1].update(sourceUrl=url))
    wide = lambda n: text(lambda d: d["pages"][0].update(components=[{"kind": "summary", "id": f"s{c}", "title": "t", "tone": "normal", "claims": [{"text": f"{i}" + "w" * n, "evidenceIds": ["reading"]} for i in range(24)]} for c in range(12)]))
    bodies = [
        text(lambda d: None), retitled("é" * 256), retitled("é" * 257), retitled("🐟" * 128), retitled("🐟" * 129), retitled("�"), retitled(""), wide(3500), wide(3600), wide(4000), linked("https://a.b/" + "é" * 2036), linked("https://a.b/" + "é" * 2037), linked("ftp://a.b/"),
        seen("2026-08-19T09:00:00Z", "2026-08-19T10:00:00Z"), seen("2026-08-19T09:00:00Z", "2026-08-19T10:00:01Z"), seen("2026-08-19T09:00:00Z", "then"), text(lambda d: d["evidence"][2].pop("retrievedAt")), text(lambda d: d["pages"][0]["components"][0]["evidenceIds"].append(None)),
        text(lambda d: d["pages"][0]["components"][1]["stations"][0].update(latitude="NaN")), text(lambda d: d["pages"][0]["components"][1]["stations"].append(None)),
    ]
    rows = spark.createDataFrame(enumerate(bodies), "doc_id int, body string").withColumn("d", F.from_json("body", DOCUMENT))
    rough = lambda byte: F.expr(f"CAST(unhex('61{byte}') AS STRING)")  # noqa: E731  two that are one text in JSON
    more = lambda e, byte: F.concat(e, F.transform(F.slice(e, 1, 1), lambda x: x.withField("id", rough(byte))))
    base = rows.where("doc_id = 0").select("d")
    odd = [base.select(F.lit(100 + i).alias("doc_id"), F.col("d").withField("evidence", more(more(F.col("d.evidence"), "FF"), b)).alias("d")) for i, b in enumerate(("FE", "62"))]
    docs = rows.select("doc_id", "d").unionByName(odd[0]).unionByName(odd[1]).checkpoint()
    kept = {r.doc_id for r in docs.where(documents.keeps_contract(F.col("d"))).collect()}
    found = {r.doc_id for r in contract_findings(docs.select("doc_id", document_json(F.col("d")).alias("body"))).collect()}
    assert kept == {0, 1, 3, 5, 7, 10, 13, 101} and found == {r.doc_id for r in docs.collect()} - kept
