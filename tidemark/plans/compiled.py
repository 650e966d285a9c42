"""Plans compiled to dashboard documents: sections, brief and next action from the facts of each plan's stations.

Many plans are compiled at once. A plan's stations, in its order, are gathered in one row (a document holds 200 at most), and
everything else is nested expressions over that row; ``documents.contract_findings`` judges the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import format_number, signed_number
from tidemark.operators.stations import RIVER, Policy
from tidemark.plans.documents import DOCUMENT, component

CALCULATED, COMPOSED = "calculations", "composition"


@dataclass(frozen=True)
class Words:
    """What a domain calls its stations and readings."""

    slug: str
    noun: str
    plural: str
    reading: str
    columns: tuple[str, str, str]
    notice: str
    source: str
    tolerance_unit: str
    unit: str = "ft"


RIVER_WORDS = Words("river", "gauge", "gauges", "water-level", ("Gauge", "Stage", "Flow"), "Readings may be provisional.", "River gauges", "ft")


def _cites(*ids: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in ids])


def _some(n: Column, noun: str, one: str, many: str) -> Column:
    """Count, noun and verb in agreement."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, one).otherwise(many))


def _of(station: Column) -> Column:
    return F.concat(F.lit("station-"), station["site_id"])


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _facts(plans: DataFrame, metrics: DataFrame, thresholds: DataFrame | None, series: DataFrame | None) -> DataFrame:
    """Plans with m, their stations in order, and t, the thresholds that a fresh reading exceeds."""
    wanted = plans.select("plan_id", F.posexplode("site_ids").alias("place", "site_id"))
    rows = metrics if series is None else metrics.join(series.select("site_id", "points"), "site_id", "left")
    rows = rows if series is not None else rows.withColumn("points", F.array().cast("array<struct<at:string,value:double>>"))
    rows = rows.withColumn("points", F.coalesce("points", F.array().cast("array<struct<at:string,value:double>>")))
    met = wanted.join(rows.select("site_id", F.struct(*rows.columns).alias("s")), "site_id")
    stations = met.groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("m"))
    out = plans.join(stations, "plan_id", "left")
    empty = lambda name, schema: F.coalesce(F.col(name), F.filter(F.array(F.lit(None).cast(schema[name].dataType.elementType)), lambda x: F.lit(False)))
    out = out.withColumn("m", empty("m", stations.schema))
    if thresholds is None:
        return out.withColumn("t", F.array().cast("array<struct<nth:int,id:string,label:string,above:double,s:struct<site_id:string,`group`:string,latest_primary:double,primary_unit:string>>>"))
    s = F.col("s")
    above = met.join(thresholds, "site_id").where((s["primary_freshness"] == "fresh") & (s["latest_primary"] > F.col("above")))
    held = above.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "label", "above", F.struct(*[s[c].alias(c) for c in ("site_id", "group", "latest_primary", "primary_unit")]).alias("s")))).alias("t"))
    return out.join(held, "plan_id", "left").withColumn("t", empty("t", held.schema))


def compile_documents(plans: DataFrame, metrics: DataFrame, as_of, words: Words = RIVER_WORDS, policy: Policy = RIVER, thresholds: DataFrame | None = None, series: DataFrame | None = None, mode: str = "demo") -> DataFrame:
    """(plan_id, dashboard): one DOCUMENT a plan.

    ``plans`` has plan_id, title, audience, framing, site_ids and pages (id, title, description, sections); a site id that
    ``metrics`` lacks is left out. ``metrics`` is ``stations.station_metrics`` of stations with latitude, longitude,
    source_name and retrieved_at; ``thresholds`` has nth (its place), id, label, site_id and above; ``series`` site_id and
    points. Sections that aren't known, and trends without two points, are left out, as are pages with nothing left.
    """
    rows = _facts(plans, metrics, thresholds, series)
    m, at = F.col("m"), _iso(F.lit(as_of).cast("timestamp"))
    fresh = lambda s: s["primary_freshness"] == "fresh"
    unit = lambda s: F.coalesce(s["primary_unit"], F.lit(words.unit))
    facts = {
        "rising": F.filter(m, lambda s: fresh(s) & (s["direction"] == "rising")),
        "falling": F.filter(m, lambda s: fresh(s) & (s["direction"] == "falling")),
        "checks": F.filter(m, lambda s: (s["freshness"] != "fresh") | (F.size(s["issues"]) > 0)),
        "sound": F.filter(m, lambda s: (s["change_1h"] > policy.material_rise) & (s["freshness"] == "fresh") & (F.size(s["issues"]) == 0)),
        "cited": F.transform(m, _of),
        "latest": F.array_max(F.transform(m, lambda s: s["latest_at"])),
    }
    for name, made in facts.items():
        rows = rows.withColumn(name, made)
    # The sort keeps the plan's order among equal rises.
    rows = rows.withColumn("ranked", F.array_sort("sound", lambda a, b: F.when(a["change_1h"] > b["change_1h"], -1).when(a["change_1h"] < b["change_1h"], 1).otherwise(0)))
    cited, with_sums = F.col("cited"), F.concat("cited", _cites(CALCULATED))
    alert = lambda i, severity, title, detail, cites: F.struct(i.alias("id"), severity.alias("severity"), title.alias("title"), detail.alias("detail"), cites.alias("evidenceIds"))
    both = lambda s: _cites(_of(s), CALCULATED)
    faults = F.flatten(F.transform(m, lambda s: F.transform(s["issues"], lambda d, i: alert(F.concat(s["site_id"], F.lit("-quality-"), i.cast("string")), F.when(s["freshness"] == "fresh", "attention").otherwise("warning"), s["group"], d, both(s)))))
    unit_of = lambda s: F.coalesce(s["primary_unit"], F.lit(""))
    said = lambda t: F.concat(t["s"]["group"], F.lit(" is "), format_number(t["s"]["latest_primary"]), F.lit(" "), unit_of(t["s"]), F.lit(", above the user threshold of "), format_number(t["above"]), F.lit(" "), unit_of(t["s"]), F.lit("."))
    exceeded = F.transform("t", lambda t: alert(t["id"], F.lit("attention"), t["label"], said(t), both(t["s"])))
    clear = F.array(alert(F.lit("no-alerts"), F.lit("info"), F.lit("No configured thresholds are active"), F.lit("All current data-quality and user-defined threshold checks are clear."), with_sums))
    rows = rows.withColumn("found", F.concat(faults, exceeded)).withColumn("alerts", F.when(F.size("found") > 0, F.col("found")).otherwise(clear))
    top = F.try_element_at("ranked", F.lit(1))
    worst = F.coalesce(F.try_element_at(F.filter("found", lambda a: a["severity"] == "warning"), F.lit(1)), F.try_element_at("found", F.lit(1)))
    broken = F.try_element_at(F.filter(m, lambda s: F.size(s["issues"]) > 0), F.lit(1))
    n = {c: F.size(c) for c in ("m", "rising", "falling", "checks", "found")}

    proof = lambda i, kind, label, source, seen, got, detail, sure: F.struct(
        i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), source.alias("sourceName"), F.lit(None).cast("string").alias("sourceUrl"), seen.alias("observedAt"), got.alias("retrievedAt"), detail.alias("detail"), F.lit(sure).alias("confidence"),
    )
    none = F.lit(None).cast("string")
    observed = F.transform(m, lambda s: proof(_of(s), "observed", F.concat(s["group"], F.lit(f" {words.noun} "), s["site_id"]), s["source_name"], _iso(s["latest_at"]), _iso(s["retrieved_at"]), F.concat(s["primary_label"], F.lit(" and "), s["secondary_label"], F.lit(" observations for "), s["name"], F.lit(".")), "high"))
    own = F.array(
        proof(F.lit(CALCULATED), "calculated", F.lit("Calculations"), F.lit("tidemark"), none, at, F.lit("Changes over 1, 6 and 24 hours, directions and rankings."), "high"),
        proof(F.lit(COMPOSED), "interpreted", F.lit("Dashboard composition"), F.lit("tidemark"), none, at, F.lit("The plan chose title, audience, stations and layout, and no value."), "medium"),
    )
    every = F.concat("cited", _cites(CALCULATED, COMPOSED))

    view = F.transform(m, lambda s: F.struct(
        s["site_id"].alias("id"), s["name"].alias("name"), s["group"].alias("group"), s["latitude"].alias("latitude"), s["longitude"].alias("longitude"),
        F.struct(s["latest_primary"].alias("value"), F.coalesce(s["primary_unit"], F.lit("")).alias("unit")).alias("primary"), F.struct(s["latest_secondary"].alias("value"), F.coalesce(s["secondary_unit"], F.lit("")).alias("unit")).alias("secondary"),
        s["direction"].alias("direction"), s["freshness"].alias("freshness"), both(s).alias("evidenceIds"),
    ))
    claim = lambda text, cites: F.struct(text.alias("text"), cites.alias("evidenceIds"))
    moving = F.concat(_some(n["rising"], words.noun, " is", "s are"), F.lit(" rising and "), n["falling"].cast("string"), F.when(n["falling"] == 1, " is").otherwise(" are"), F.lit(" falling."))
    fastest = F.when(top.isNull(), f"No fresh, complete {words.noun} is rising fast enough to rank over the last hour.").otherwise(F.concat(top["group"], F.lit(f" is the fastest-rising complete {words.noun} over the last hour at "), signed_number(top["change_1h"], unit(top)), F.lit(".")))
    checks = F.when(n["checks"] > 0, F.concat(_some(n["checks"], words.noun, " needs", "s need"), F.lit(" a freshness or completeness check."))).otherwise(f"All selected {words.plural} are fresh and complete.")
    metric = lambda label, value, way, cites: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), none.alias("change"), way.cast("string").alias("direction"), cites.alias("evidenceIds"))
    item = lambda s, value, note: F.struct(s["site_id"].alias("id"), s["group"].alias("label"), value.alias("value"), note.alias("note"), both(s).alias("evidenceIds"))
    change = lambda s, h: F.concat(F.lit(f"{h}h "), signed_number(s[f"change_{h}h"], unit(s)))
    lines = F.transform(F.filter(m, lambda s: F.size(s["points"]) >= 2), lambda s: F.struct(s["site_id"].alias("id"), s["group"].alias("label"), unit(s).alias("unit"), s["points"].alias("points"), _cites(_of(s)).alias("evidenceIds")))
    title = words.plural.capitalize()
    sections = {
        "conditions-summary": component("summary", "conditions-summary", "Conditions summary", every, subtitle=F.col("framing"), tone=F.when(n["checks"] > 0, "attention").otherwise("normal"), claims=F.array(
            claim(moving, with_sums), claim(fastest, F.when(top.isNull(), _cites(CALCULATED)).otherwise(both(top))), claim(checks, F.when(n["checks"] > 0, F.transform("checks", _of)).otherwise(cited)))),
        "headline-metrics": component("metric-grid", "headline-metrics", "At a glance", every, metrics=F.array(
            metric(f"{title} monitored", n["m"], none, cited), metric("Rising", n["rising"], F.lit("up"), with_sums), metric("Falling", n["falling"], F.lit("down"), with_sums), metric("Freshness checks", n["checks"], F.when(n["checks"] > 0, "unknown").otherwise("steady"), with_sums))),
        "gauge-map": component("station-map", "gauge-map", f"{words.noun.capitalize()} map", cited, subtitle=F.lit("Select a point for current conditions"), stations=view),
        "gauge-table": component("station-table", "gauge-table", "Current readings", cited, stations=view, columns=F.struct(*[F.lit(w).alias(c) for w, c in zip(words.columns, ("station", "primary", "secondary"))])),
        "fastest-rising": component("ranking", "fastest-rising", f"Fastest-rising {words.plural}", with_sums, subtitle=F.lit(f"Fresh, complete {words.plural} ranked by one-hour {words.reading} rise"),
            items=F.transform("ranked", lambda s: item(s, signed_number(s["change_1h"], unit(s)), F.concat(s["direction"], F.lit("; 6h "), signed_number(s["change_6h"], unit(s)))))),
        "change-windows": component("ranking", "change-windows", "Change windows", with_sums, items=F.transform(m, lambda s: item(s, change(s, 1), F.concat_ws(" · ", change(s, 6), change(s, 24))))),
        "stage-trends": F.when(F.size(lines) > 0, component("trend-list", "stage-trends", f"Recent {words.reading} trends", with_sums, series=lines)),
        "attention": component("alert-list", "attention", "Needs attention", every, alerts=F.col("alerts")),
    }
    rows = rows.withColumn("made", F.struct(*[made.alias(name) for name, made in sections.items()]))
    chosen = lambda kind: F.coalesce(*[F.when(kind == name, F.col("made")[name]) for name in sections])
    pages = F.filter(F.transform("pages", lambda p: F.struct(p["id"].alias("id"), p["title"].alias("title"), p["description"].alias("description"), F.filter(F.transform(p["sections"], chosen), lambda c: c.isNotNull()).alias("components"))), lambda p: F.size(p["components"]) > 0)

    told = lambda kinds, headline, detail, cites: F.struct(_cites(*kinds).alias("statementTypes"), headline.alias("headline"), detail.alias("detail"), cites.alias("evidenceIds"))
    known = told(["observed", "calculated"], _some(n["m"], words.noun, " monitored", "s monitored"), F.concat(_some(n["rising"], words.noun, " is", "s are"), F.lit(" rising and "), _some(n["falling"], words.noun, " is", "s are"), F.lit(f" falling based on fresh {words.reading} readings.")), with_sums)
    changed = F.when(top.isNotNull(), told(["calculated"], F.concat(top["group"], F.lit(" rose fastest")), F.concat(F.lit("The fastest fresh, complete material one-hour rise is "), signed_number(top["change_1h"], unit(top)), F.lit(" at "), top["name"], F.lit(".")), both(top))).otherwise(
        told(["calculated"], F.lit("No material one-hour rise available"), F.lit(f"No fresh, complete {words.noun} rose more than {policy.material_rise:g} {words.tolerance_unit} over the last hour."), with_sums)
    )
    important = F.when(n["found"] > 0, told(["interpreted"], F.concat(_some(n["found"], "item", "", "s"), F.lit(" need attention")), F.concat(F.lit("Highest priority: "), worst["title"], F.lit(" — "), worst["detail"]), F.array_distinct(F.flatten(F.transform("found", lambda a: a["evidenceIds"]))))).otherwise(
        told(["interpreted"], F.lit("Configured checks are clear"), F.lit("No data-quality check needs attention."), with_sums)
    )
    act = lambda title, detail, cites: F.struct(title.alias("title"), detail.alias("detail"), cites.alias("evidenceIds"))
    action = F.when(broken.isNotNull(), act(F.concat(F.lit("Review "), broken["group"], F.lit(f" {words.noun}")), F.concat(broken["name"], F.lit(": "), broken["issues"][0]), _cites(_of(broken)))).otherwise(
        act(F.lit("Review the dashboard before sharing"), F.lit("Confirm the calculated conditions match the source readings and the intended audience."), _cites(CALCULATED))
    )
    node = lambda i, label, kind: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(f"{label}.").alias("detail"), F.lit(kind).alias("kind"))
    steps = [("request", "Request", "input"), ("source", words.source, "input"), ("calculate", "Calculate change", "process"), ("pages", "Dashboard pages", "page")]
    edge = lambda a, b, label: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(label).alias("label"))
    drawing = F.struct(F.lit("How this dashboard works").alias("title"), F.lit(f"Every number comes from {words.source.lower()}.").alias("summary"), F.array(*[node(*s) for s in steps]).alias("nodes"), F.array(edge("request", "pages", "layout"), edge("source", "calculate", "readings"), edge("calculate", "pages", "metrics")).alias("edges"))
    attention = F.concat(n["checks"].cast("string"), F.lit(f" {words.noun}"), F.when(n["checks"] == 1, " needs").otherwise("s need"), F.lit(" attention"))
    freshness = F.struct(F.when(n["checks"] > 0, "partial").otherwise("fresh").alias("status"), F.when(n["checks"] > 0, attention).otherwise(f"All {words.plural} fresh").alias("label"), _iso(F.col("latest")).alias("latestObservationAt"))
    document = F.struct(
        F.lit("1.2").alias("schemaVersion"), F.lit(f"planned-{words.slug}-conditions").alias("id"), "title", "audience", at.alias("generatedAt"), F.lit(mode).alias("dataMode"), freshness.alias("freshness"), action.alias("nextAction"), F.lit(words.notice).alias("notice"),
        pages.alias("pages"), F.concat(observed, own).alias("evidence"), drawing.alias("architecture"), F.struct(known.alias("known"), changed.alias("changed"), important.alias("important")).alias("executiveBrief"),
    )
    return rows.select("plan_id", document.cast(DOCUMENT).alias("dashboard"))
