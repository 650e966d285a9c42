"""Dashboard documents: their contract as a table of shapes, findings of whole documents, and composition of several.

A document is JSON text or a struct of the type DOCUMENT. A text that is just what ``document_json`` writes of the struct that
it is read as has neither unknown fields nor wrong types, so the struct tells whether it is sound, in its own row. All other
texts, and those that aren't surely sound, are taken apart into rows (see sources.shapes); one exchange of them by document
serves every check of uniqueness, references, times and budgets.
Composition is one row a request: each request's few members are gathered, rewritten by nested transforms and judged there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import bound
from tidemark.operators.evidence import merged_statements
from tidemark.session import with_checkpoints
from tidemark.sources.shapes import Contract, finding, findings, instant, literal_map, records

# The fields of a document with their shapes (see sources.shapes), its budgets, and the words of composed
# documents.
_ID, _SHORT, _LONG = "text/1/128", "text/1/256", "text/1/4096"
_SHORT_OR_EMPTY, _LONG_OR_EMPTY = "text/0/256", "text/0/4096"
_CITES = {"evidenceIds": f"list/1/32/{_ID}"}
_KINDS = "summary|metric-grid|station-map|station-table|ranking|trend-list|alert-list"
_PART = {"kind": f"choice/{_KINDS}", "id": _ID, "title": _SHORT, "subtitle?": _LONG_OR_EMPTY, "evidenceIds?": f"list/0/32/{_ID}"}
RECORDS: dict[str, dict[str, str]] = {
    "dashboard": {
        "schemaVersion": "choice/1.2", "id": _ID, "title": _SHORT, "audience": _SHORT, "generatedAt": "instant", "dataMode": "choice/demo|live", "freshness": "freshness", "nextAction": "next",
        "notice": _LONG, "pages": "list/1/16/page", "evidence": "list/0/500/evidence", "architecture": "architecture", "executiveBrief": "brief",
    },
    "freshness": {"status": "choice/fresh|stale|partial", "label": _SHORT, "latestObservationAt?": "instant"},
    "next": {"title": _SHORT, "detail": _LONG, **_CITES},
    "page": {"id": _ID, "title": _SHORT, "description": _LONG, "components": "list/1/24/component"},
    "evidence": {"id": _ID, "kind": "choice/observed|calculated|interpreted|recommended", "label": _SHORT, "sourceName": _SHORT, "sourceUrl?": "url", "observedAt?": "instant", "retrievedAt": "instant", "detail": _LONG, "confidence": "choice/high|medium|low"},
    "architecture": {"title": _SHORT, "summary": _LONG, "nodes": "list/2/64/node", "edges": "list/1/256/edge"},
    "node": {"id": _ID, "label": _SHORT, "detail": _LONG, "kind": "choice/input|process|ai|page|output"},
    "edge": {"from": _ID, "to": _ID, "label": _SHORT},
    "brief": {"known": "statement", "changed": "statement", "important": "statement"},
    "statement": {"statementTypes": "list/1/2/choice/observed|calculated|interpreted", "headline": _SHORT, "detail": _LONG, **_CITES},
    "component:summary": {**_PART, "claims": "list/1/24/claim", "tone": "choice/normal|attention|warning"},
    "component:metric-grid": {**_PART, "metrics": "list/1/24/metric"},
    "component:station-map": {**_PART, "stations": "list/1/200/station"},
    "component:station-table": {**_PART, "stations": "list/1/200/station", "columns": "columns"},
    "component:ranking": {**_PART, "items": "list/0/100/item"},
    "component:trend-list": {**_PART, "series": "list/0/100/series"},
    "component:alert-list": {**_PART, "alerts": "list/0/200/alert"},
    "claim": {"text": _LONG, **_CITES},
    "metric": {"label": _SHORT, "value": _SHORT, "change?": _SHORT_OR_EMPTY, "direction?": "choice/up|down|steady|unknown", **_CITES},
    "station": {"id": _ID, "name": _SHORT, "group": _SHORT, "latitude": "number/-90/90", "longitude": "number/-180/180", "primary": "measured", "secondary": "measured", "direction": "choice/rising|falling|steady|unknown", "freshness": "choice/fresh|stale|missing", **_CITES},
    "measured": {"value": "reading", "unit": _SHORT_OR_EMPTY},
    "columns": {"station": _SHORT, "primary": _SHORT, "secondary": _SHORT},
    "item": {"id": _ID, "label": _SHORT, "value": _SHORT, "note?": _LONG_OR_EMPTY, **_CITES},
    "series": {"id": _ID, "label": _SHORT, "unit": _SHORT, "points": "list/2/5000/point", **_CITES},
    "point": {"at": "instant", "value": "number"},
    "alert": {"id": _ID, "severity": "choice/info|attention|warning", "title": _SHORT, "detail": _LONG, **_CITES},
}
MAX_BYTES, MAX_ITEMS, MAX_POINTS, MAX_REFERENCES, MAX_CITED, MAX_MEMBERS = 1_048_576, 2_000, 10_000, 10_000, 32, 3
#: Of each list whose members must differ, the field by which they must.
UNIQUE = {"pages": "id", "evidence": "id", "nodes": "id", "components": "id", "stations": "id", "items": "id", "series": "id", "alerts": "id", "claims": "text", "metrics": "label"}
ABSENT_DETAIL, ABSENT_HEADLINE = "unavailable when this dashboard was built.", "unavailable"
SENTENCE_ENDS, CLOSERS = ".!?…", ")]\"'”’"

_CITED = "array<string>"
_LISTS = {
    "claims": f"struct<text:string,evidenceIds:{_CITED}>",
    "metrics": f"struct<label:string,value:string,change:string,direction:string,evidenceIds:{_CITED}>",
    "stations": f"struct<id:string,name:string,`group`:string,latitude:double,longitude:double,primary:struct<value:double,unit:string>,secondary:struct<value:double,unit:string>,direction:string,freshness:string,evidenceIds:{_CITED}>",
    "items": f"struct<id:string,label:string,value:string,note:string,evidenceIds:{_CITED}>",
    "series": f"struct<id:string,label:string,unit:string,points:array<struct<at:string,value:double>>,evidenceIds:{_CITED}>",
    "alerts": f"struct<id:string,severity:string,title:string,detail:string,evidenceIds:{_CITED}>",
}
COMPONENT = f"struct<kind:string,id:string,title:string,subtitle:string,evidenceIds:{_CITED},tone:string,columns:struct<station:string,primary:string,secondary:string>,{','.join(f'{n}:array<{t}>' for n, t in _LISTS.items())}>"
_STATEMENT = f"struct<statementTypes:array<string>,headline:string,detail:string,evidenceIds:{_CITED}>"
EVIDENCE = "struct<id:string,kind:string,label:string,sourceName:string,sourceUrl:string,observedAt:string,retrievedAt:string,detail:string,confidence:string>"
DOCUMENT = (
    f"struct<schemaVersion:string,id:string,title:string,audience:string,generatedAt:string,dataMode:string,freshness:struct<status:string,label:string,latestObservationAt:string>,"
    f"nextAction:struct<title:string,detail:string,evidenceIds:{_CITED}>,notice:string,pages:array<struct<id:string,title:string,description:string,components:array<{COMPONENT}>>>,evidence:array<{EVIDENCE}>,"
    f"architecture:struct<title:string,summary:string,nodes:array<struct<id:string,label:string,detail:string,kind:string>>,edges:array<struct<`from`:string,`to`:string,label:string>>>,"
    f"executiveBrief:struct<known:{_STATEMENT},changed:{_STATEMENT},important:{_STATEMENT}>>"
)


def component(kind: str, name: str, title: str, cites: Column, **fields: Column) -> Column:
    """A component as a struct of the type COMPONENT; what isn't given is null."""
    given = {"kind": F.lit(kind), "id": F.lit(name), "title": F.lit(title), "evidenceIds": cites, **fields}
    of = {"kind": "string", "id": "string", "title": "string", "subtitle": "string", "evidenceIds": _CITED, "tone": "string", "columns": "struct<station:string,primary:string,secondary:string>"} | {n: f"array<{t}>" for n, t in _LISTS.items()}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in of.items()])


def document_json(document: Column) -> Column:
    """JSON text of a document. Fields that are null are left out, but for a reading, which is there as null."""
    return F.regexp_replace(F.to_json(document), r'"(primary|secondary)":\{"unit"', '"$1":{"value":null,"unit"')


# --- findings ----------------------------------------------------------------------------------------------------------

#: A trend's point has the deepest fields.
CONTRACT = Contract(RECORDS, "dashboard", MAX_BYTES, depth=9, by_kind=("component",))


def _duplicates(rows: DataFrame) -> DataFrame:
    """Repeated ids, claims, metrics, statement types and edges."""
    element = r"^(.*\.(\w+))\[\d+\](?:\.(\w+))?\z"
    held, field = F.regexp_extract("path", element, 2), F.regexp_extract("path", element, 3)
    scope = F.when(held == "components", F.lit("$.pages[*].components")).otherwise(F.regexp_extract("path", element, 1))
    by = F.try_element_at(literal_map(UNIQUE | {"statementTypes": ""}), held)
    marked = rows.where(F.col("said").isNotNull() & (field == by)).select("doc_id", F.concat(F.lit("duplicate-"), held).alias("code"), scope.alias("path"), F.col("said").alias("detail"))
    again = marked.groupBy("doc_id", "code", "path", "detail").count().where("count > 1").drop("count")
    edges = records(rows, r"\$\.architecture\.edges\[\d+\]", "from", "to", "label").groupBy("doc_id", "from", "to", "label").count().where("count > 1")
    return again.unionByName(edges.select("doc_id", F.lit("duplicate-edges").alias("code"), F.lit("$.architecture.edges").alias("path"), F.concat_ws(" ", "from", F.lit("->"), "to", "label").alias("detail")))


def _dangling(rows: DataFrame) -> DataFrame:
    """References to evidence and nodes that the document lacks."""
    pointers = rows.where(F.rlike("path", F.lit(r"\.evidenceIds\[\d+\]\z")) & F.col("said").isNotNull())
    edges = rows.where(F.rlike("path", F.lit(r"^\$\.architecture\.edges\[\d+\]\.(from|to)\z")) & F.col("said").isNotNull())
    owners = lambda which: rows.where(F.rlike("path", F.lit(which)) & F.col("said").isNotNull()).select("doc_id", "said").distinct()
    say = lambda found, code: found.select("doc_id", F.lit(code).alias("code"), "path", F.col("said").alias("detail"))
    missing = pointers.join(owners(r"^\$\.evidence\[\d+\]\.id\z"), ["doc_id", "said"], "left_anti")
    unknown = edges.join(owners(r"^\$\.architecture\.nodes\[\d+\]\.id\z"), ["doc_id", "said"], "left_anti")
    return say(missing, "missing-evidence").unionByName(say(unknown, "missing-node"))


def _times(rows: DataFrame) -> DataFrame:
    """Times out of order, freshness without a time, and readings without a unit."""
    made = records(rows, r"\$", "generatedAt").select("doc_id", instant(F.col("generatedAt")).alias("made"))
    told = records(rows, r"\$\.freshness", "status", "latestObservationAt").join(made, "doc_id", "left")
    evidence = records(rows, r"\$\.evidence\[\d+\]", "observedAt", "retrievedAt").join(made, "doc_id", "left")
    readings = records(rows, r"\$.*\.(?:primary|secondary)", "value", "unit")
    latest, retrieved = instant(F.col("latestObservationAt")), instant(F.col("retrievedAt"))
    place = lambda field: F.concat("at", F.lit(f".{field}"))
    late = [
        F.when(instant(F.col("observedAt")) > retrieved, finding("observed-after-retrieval", place("observedAt"), F.col("observedAt"))),
        F.when(retrieved > F.col("made"), finding("retrieved-after-generation", place("retrievedAt"), F.col("retrievedAt"))),
    ]
    fresh = [
        F.when((F.col("status") == "fresh") & F.col("latestObservationAt").isNull(), finding("fresh-without-time", place("latestObservationAt"))),
        F.when(latest > F.col("made"), finding("freshness-after-generation", place("latestObservationAt"), F.col("latestObservationAt"))),
    ]
    nameless = F.when((F.col("unit") == "") & F.col("value").isNotNull(), finding("unit-missing", place("unit")))
    return findings(evidence, *late).unionByName(findings(told, *fresh)).unionByName(findings(readings, nameless))


def _budgets(rows: DataFrame) -> DataFrame:
    """Totals of a whole document over their limits."""
    held = F.regexp_extract("path", r"\.(\w+)\[\d+\]\z", 1)
    items = F.count_if(held.isin(*UNIQUE, "edges")).alias("items")
    totals = rows.groupBy("doc_id").agg(items, F.count_if(held == "points").alias("points"), F.count_if(held == "evidenceIds").alias("references"))
    faults = [F.when(F.col(c) > most, finding(f"too-many-{c}", F.lit("$"), F.col(c))) for c, most in (("items", MAX_ITEMS), ("points", MAX_POINTS), ("references", MAX_REFERENCES))]
    return findings(totals, *faults)


def _consistent(d: Column, parts: Column) -> Column:
    """What _duplicates, _dangling, _times and _budgets check, of a struct whose values keep their shapes, and its components."""
    each = lambda of, name: F.transform(of, lambda x: x[name])
    differ = lambda ids: F.size(F.array_distinct(ids)) == F.size(ids)
    inside = lambda x, name: F.coalesce(x[name], F.array().cast(f"array<{_LISTS[name]}>"))
    total = lambda of, size: F.aggregate(of, F.lit(0), lambda n, x: n + size(x))
    evidence, nodes, edges = d["evidence"], d["architecture"]["nodes"], d["architecture"]["edges"]
    statements = [d["executiveBrief"][k] for k in ("known", "changed", "important")]

    unique = [differ(each(of, UNIQUE[n])) for n, of in (("pages", d["pages"]), ("evidence", evidence), ("nodes", nodes), ("components", parts))]
    unique += [F.forall(parts, lambda c: reduce(and_, [differ(each(inside(c, n), UNIQUE[n])) for n in _LISTS])), differ(edges), *[differ(s["statementTypes"]) for s in statements]]

    cites = lambda c: F.flatten(F.array(F.coalesce(c["evidenceIds"], F.array().cast(_CITED)), *[F.flatten(each(inside(c, n), "evidenceIds")) for n in _LISTS]))  # noqa: E731  concat is slower
    cited = F.concat(F.flatten(F.transform(parts, cites)), d["nextAction"]["evidenceIds"], *[s["evidenceIds"] for s in statements])
    known = bound(F.struct(cited.alias("cited"), each(evidence, "id").alias("ids")), lambda x: (F.size(x["cited"]) <= MAX_REFERENCES) & (F.size(F.array_except(x["cited"], x["ids"])) == 0))
    joined = F.size(F.array_except(F.concat(each(edges, "from"), each(edges, "to")), each(nodes, "id"))) == 0

    latest = d["freshness"]["latestObservationAt"]
    seen = lambda e, made: bound(instant(e["retrievedAt"]), lambda at: (at <= made) & (e["observedAt"].isNull() | (instant(e["observedAt"]) <= at)))
    told = F.array_distinct(F.transform(evidence, lambda e: F.struct(e["observedAt"].alias("observedAt"), e["retrievedAt"].alias("retrievedAt"))))  # most are alike
    in_order = bound(instant(d["generatedAt"]), lambda made: F.forall(told, lambda e: seen(e, made)) & F.when(latest.isNull(), d["freshness"]["status"] != "fresh").otherwise(instant(latest) <= made))
    named = F.forall(parts, lambda c: F.forall(inside(c, "stations"), lambda s: reduce(and_, [s[m]["value"].isNull() | (s[m]["unit"] != "") for m in ("primary", "secondary")])))

    items = reduce(add, [F.size(x) for x in (d["pages"], evidence, nodes, edges, parts)]) + total(parts, lambda c: reduce(add, [F.size(inside(c, n)) for n in _LISTS]))
    points = total(parts, lambda c: total(inside(c, "series"), lambda s: F.size(s["points"])))
    return reduce(and_, [*unique, known, joined, in_order, named, items <= MAX_ITEMS, points <= MAX_POINTS])


def _sound(d: Column) -> Column:
    parts = F.flatten(F.transform(d["pages"], lambda p: p["components"]))
    return F.coalesce(CONTRACT.holds("dashboard", d) & bound(parts, lambda c: _consistent(d, c)), F.lit(False))


def surely_sound(body: Column) -> Column:
    """True only for a text without findings; false for those with findings, and for some that are sound but spelled otherwise."""
    return F.coalesce((F.octet_length(body) <= MAX_BYTES) & bound(F.from_json(body, DOCUMENT), lambda d: (document_json(d) == body) & _sound(d)), F.lit(False))


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """As ``bound``, but what ``then`` returns isn't copied: for whole documents."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, then)


def keeps_contract(document: Column) -> Column:
    """Whether ``contract_findings`` has nothing to say of a struct's JSON text, told in its row; never null."""

    def judged(text: Column) -> Column:
        # Two readings a station and no more stations than items; only texts near the limit are spelled out.
        small = F.octet_length(text) <= MAX_BYTES - 2 * MAX_ITEMS * len('"value":null,')
        # Bytes that aren't UTF-8 are U+FFFD in JSON; then, and where a struct isn't sound, what JSON makes of it counts.
        as_is = F.when(~F.contains(text, F.lit("\ufffd")), document)
        either = lambda i: F.when(i == 0, as_is).otherwise(F.from_json(document_json(document), DOCUMENT))
        return (small | (F.octet_length(document_json(document)) <= MAX_BYTES)) & F.exists(F.array(F.lit(0), F.lit(1)), lambda i: given(either(i), _sound))

    return F.coalesce(given(F.to_json(document), judged), F.lit(False))


def contract_findings(documents: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, code, path, detail): everything that keeps a document from its contract; a sound document has no row.

    ``documents`` has doc_id and JSON text, and is read once. Null text is no JSON. Rows that repeat a doc_id may count as one
    document with repeated ids, so keep them apart.
    """
    with_checkpoints(documents.sparkSession)
    # The text and its struct are bound, so that neither is computed again; only texts that aren't surely sound are moved.
    each = F.array(F.struct("doc_id", F.col(body).alias("body")))
    suspects = documents.select(F.explode_outer(F.filter(each, lambda d: ~surely_sound(d["body"]))).alias("d")).where("d IS NOT NULL").select("d.*")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of their own: texts grow much when taken apart
    suspects = suspects.repartition(parts, "doc_id").checkpoint()
    rows = CONTRACT.rows(suspects).checkpoint()  # texts are smaller than their rows
    found = CONTRACT.unread(suspects).unionByName(CONTRACT.shape_findings(rows))
    for more in (_duplicates(rows), _dangling(rows), _times(rows), _budgets(rows)):
        found = found.unionByName(more)
    return found


# --- composition -------------------------------------------------------------------------------------------------------


def _joined(members: Column, say: Callable[[Column], Column]) -> Column:
    """Labels and headlines in the members' order."""
    return F.array_join(F.transform(members, lambda m: F.concat(m["label"], F.lit(": "), F.when(m["dashboard"].isNull(), ABSENT_HEADLINE).otherwise(F.coalesce(say(m["dashboard"]), F.lit(""))))), " · ")


def _attributed(members: Column, say: Callable[[Column], Column]) -> Column:
    """Labels and sentences in the members' order; all but the last end as sentences do."""
    ended = rf"[{SENTENCE_ENDS}][{''.join(chr(92) + c for c in CLOSERS)}]?\z"
    parts = F.transform(members, lambda m: F.struct(m["label"].alias("label"), F.regexp_replace(F.when(m["dashboard"].isNull(), ABSENT_DETAIL).otherwise(F.coalesce(say(m["dashboard"]), F.lit(""))), r"(?U)\s+\z", "").alias("said")))
    whole = F.transform(parts, lambda p, i: F.concat(p["label"], F.lit(": "), p["said"], F.when((i == F.size(members) - 1) | F.rlike(p["said"], F.lit(ended)), "").otherwise(".")))
    return F.array_join(whole, " ")


def _named(key: Column, value: Column) -> Column:
    return F.concat(key, F.lit(":"), value)


def _all_named(key: Column, values: Column) -> Column:
    return F.transform(values, lambda x: _named(key, x))


def _in_turns(lists: Column) -> Column:
    """Ids of several lists in turns, each once, MAX_CITED at most."""
    longest = F.greatest(F.array_max(F.transform(lists, F.size)), F.lit(0))
    turns = F.transform(F.sequence(F.lit(0), longest), lambda i: F.filter(F.transform(lists, lambda x: F.get(x, i)), lambda x: x.isNotNull()))
    return F.slice(F.array_distinct(F.flatten(turns)), 1, MAX_CITED)


def _flat(sources: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(sources, lambda s: each(s["key"], s["dashboard"])))


def _component(key: Column, component: Column) -> Column:
    """A component with its id and every reference moved. Ids that readers see (stations, items, series) stay."""
    moved = component.withField("id", _named(key, component["id"])).withField("evidenceIds", _all_named(key, component["evidenceIds"]))
    for name in _LISTS:
        moved = moved.withField(name, F.transform(component[name], lambda x: x.withField("evidenceIds", _all_named(key, x["evidenceIds"]))))
    return moved


def _page(key: Column, label: Column, page: Column) -> Column:
    named = page.withField("id", _named(key, page["id"])).withField("title", F.concat(label, F.lit(" — "), page["title"]))
    return named.withField("components", F.transform(page["components"], lambda c: _component(key, c)))


def _brief(members: Column, sources: Column, which: str) -> Column:
    claim = lambda d: d["executiveBrief"][which]
    return F.struct(
        merged_statements(_flat(sources, lambda k, d: claim(d)["statementTypes"])).alias("statementTypes"),
        _joined(members, lambda d: claim(d)["headline"]).alias("headline"),
        _attributed(members, lambda d: claim(d)["detail"]).alias("detail"),
        _in_turns(F.transform(sources, lambda s: _all_named(s["key"], claim(s["dashboard"])["evidenceIds"]))).alias("evidenceIds"),
    ).alias(which)


def _freshness(members: Column, sources: Column) -> Column:
    told = F.transform(sources, lambda s: s["dashboard"]["freshness"])
    every = lambda what: F.size(F.filter(told, lambda f: f["status"] == what)) == F.size(members)
    dated = F.filter(told, lambda f: f["latestObservationAt"].isNotNull())
    earliest = F.array_min(F.transform(dated, lambda f, i: F.struct(instant(f["latestObservationAt"]).alias("at"), i.alias("nth"), f["latestObservationAt"].alias("said"))))
    return F.struct(
        F.when(every("fresh"), "fresh").when(every("stale"), "stale").otherwise("partial").alias("status"),
        _joined(members, lambda d: d["freshness"]["label"]).alias("label"),
        F.when(F.size(dated) == F.size(members), earliest["said"]).alias("latestObservationAt"),
    )


def _composed(request: dict[str, Column], m: Column, s: Column, modes: Column) -> Column:
    """The document of a request's members ``m``, of which ``s`` did load."""
    made = F.array_max(F.transform(s, lambda x, i: F.struct(instant(x["dashboard"]["generatedAt"]).alias("at"), (-i).alias("nth"), x["dashboard"]["generatedAt"].alias("said"))))
    action = F.struct(
        _joined(m, lambda d: d["nextAction"]["title"]).alias("title"),
        _attributed(m, lambda d: d["nextAction"]["detail"]).alias("detail"),
        _in_turns(F.transform(s, lambda x: _all_named(x["key"], x["dashboard"]["nextAction"]["evidenceIds"]))).alias("evidenceIds"),
    )
    drawing = F.struct(
        request["title"].alias("title"),
        _attributed(m, lambda d: d["architecture"]["summary"]).alias("summary"),
        _flat(s, lambda k, d: F.transform(d["architecture"]["nodes"], lambda n: n.withField("id", _named(k, n["id"])))).alias("nodes"),
        _flat(s, lambda k, d: F.transform(d["architecture"]["edges"], lambda e: e.withField("from", _named(k, e["from"])).withField("to", _named(k, e["to"])))).alias("edges"),
    )
    named = {n: c.alias(n) for n, c in request.items()}
    document = F.struct(
        F.lit("1.2").alias("schemaVersion"), named["id"], named["title"], named["audience"], made["said"].alias("generatedAt"), F.get(modes, F.lit(0)).alias("dataMode"), _freshness(m, s).alias("freshness"), action.alias("nextAction"), named["notice"],
        F.flatten(F.transform(s, lambda x: F.transform(x["dashboard"]["pages"], lambda p: _page(x["key"], x["label"], p)))).alias("pages"),
        _flat(s, lambda k, d: F.transform(d["evidence"], lambda e: e.withField("id", _named(k, e["id"])))).alias("evidence"),
        drawing.alias("architecture"), F.struct(*[_brief(m, s, c) for c in ("known", "changed", "important")]).alias("executiveBrief"),
    )
    return document.cast(DOCUMENT)


def _outcome(request: dict[str, Column], m: Column, s: Column) -> Column:
    """(refusal, dashboard) of a request."""
    modes, keys = F.array_distinct(F.transform(s, lambda x: x["dashboard"]["dataMode"])), F.transform(m, lambda x: x["key"])
    refusal = (
        F.when(F.size(m) < 2, "too-few-sources").when(F.size(m) > MAX_MEMBERS, "too-many-sources").when(F.size(s) < 1, "none-loaded")
        .when(F.size(F.array_distinct(keys)) < F.size(m), "repeated-key").when(F.size(modes) > 1, "mixed-modes")
    )
    outcome = lambda why, d: F.struct(why.cast("string").alias("refusal"), d.cast(DOCUMENT).alias("dashboard"))
    judged = lambda d: F.when(keeps_contract(d), outcome(F.lit(None), d)).otherwise(outcome(F.lit("breaks-contract"), F.lit(None)))
    return given(refusal, lambda why: F.when(why.isNotNull(), outcome(why, F.lit(None))).otherwise(given(_composed(request, m, s, modes), judged)))


def compose_gathered(requests: DataFrame) -> DataFrame:
    """``compose_documents`` of requests that have their members with them, as an array ``members`` of structs.

    Everything of a request is made and judged in its own row: nothing is moved, written or made twice.
    """
    request = {n: F.col(n) for n in ("id", "title", "audience", "notice")}
    few = F.slice(F.sort_array(F.coalesce("members", F.array().cast(requests.schema["members"].dataType))), 1, MAX_MEMBERS + 1)
    made = given(few, lambda m: given(F.filter(m, lambda x: x["dashboard"].isNotNull()), lambda s: _outcome(request, m, s)))
    return requests.select("request_id", made.alias("made")).select("request_id", "made.refusal", "made.dashboard")


def compose_documents(members: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, refusal, dashboard): one composed document for each request, or why it can't be.

    ``members`` has request_id, place, key, label and dashboard (a DOCUMENT; null for a source that didn't load), two or
    three a request; ``requests`` has request_id, id, title, audience and notice. Refusals: too-few-sources (also for a
    request without members), too-many-sources, none-loaded, repeated-key, mixed-modes, and breaks-contract, where
    ``contract_findings`` has something to say about the result.
    """
    order = Window.partitionBy("request_id").orderBy("place", "key")
    few = members.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= MAX_MEMBERS + 1)  # so a row stays small
    held = few.groupBy("request_id").agg(F.collect_list(F.struct("place", "key", "label", "dashboard")).alias("members"))
    return compose_gathered(requests.join(held, "request_id", "left"))
