"""Dashboard sections as queries over station metrics, plan findings, and composition of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import directives, measurements, signed_number
from tidemark.operators.stations import RIVER, Policy, ranked


def headline_metrics(metrics: DataFrame, noun: str = "gauges") -> DataFrame:
    """(place, label, value, direction): four counts in one aggregation."""
    fresh = F.col("primary_freshness") == "fresh"
    n = metrics.agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(fresh & (F.col("direction") == "rising")).alias("rising"),
        F.count_if(fresh & (F.col("direction") == "falling")).alias("falling"),
        F.count_if((F.col("freshness") != "fresh") | (F.size("issues") > 0)).alias("checks"),
    )
    row = lambda place, label, value, way: F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), F.col(value).alias("value"), way.alias("direction"))
    none = F.lit(None).cast("string")
    checks = F.when(F.col("checks") > 0, "unknown").otherwise("steady")
    rows = F.array(row(1, f"{noun.capitalize()} monitored", "all", none), row(2, "Rising", "rising", F.lit("up")), row(3, "Falling", "falling", F.lit("down")), row(4, "Freshness checks", "checks", checks))
    return n.select(F.explode(rows).alias("r")).select("r.*")


def conditions_summary(metrics: DataFrame, policy: Policy = RIVER, noun: str = "gauge") -> DataFrame:
    """(place, claim): what moves, what rises fastest, what needs a check."""
    fresh = F.col("primary_freshness") == "fresh"
    checked = (F.col("freshness") != "fresh") | (F.size("issues") > 0)
    rises = fresh & ~checked & (F.col("change_1h") > policy.material_rise)
    first = F.min(F.when(rises, F.struct((-F.col("change_1h")).alias("fall"), "site_id", "group", F.col("primary_unit").alias("unit")))).alias("top")
    c = metrics.agg(F.count_if(fresh & (F.col("direction") == "rising")).alias("up"), F.count_if(fresh & (F.col("direction") == "falling")).alias("down"), F.count_if(checked).alias("checks"), first)
    c = c.select("up", "down", "checks", "top.group", (-F.col("top.fall")).alias("change"), "top.unit")
    some = lambda n, one, many: F.when(F.col(n) == 1, one).otherwise(many)
    first = F.concat(F.col("up").cast("string"), F.lit(f" {noun}"), some("up", " is", "s are"), F.lit(" rising and "), F.col("down").cast("string"), some("down", " is", " are"), F.lit(" falling."))
    second = F.when(F.col("group").isNull(), f"No fresh, complete {noun} is rising fast enough to rank over the last hour.").otherwise(
        F.concat(F.col("group"), F.lit(f" is the fastest-rising complete {noun} over the last hour at "), signed_number(F.col("change"), F.coalesce("unit", F.lit("ft"))), F.lit("."))
    )
    third = F.when(F.col("checks") > 0, F.concat(F.col("checks").cast("string"), F.lit(f" {noun}"), some("checks", " needs", "s need"), F.lit(" a freshness or completeness check."))).otherwise(f"All selected {noun}s are fresh and complete.")
    return c.select(F.posexplode(F.array(first, second, third)).alias("place", "claim"))


def change_windows(metrics: DataFrame) -> DataFrame:
    unit = F.coalesce("primary_unit", F.lit("ft"))
    shown = lambda h: F.concat(F.lit(f"{h}h "), signed_number(F.col(f"change_{h}h"), unit))
    return metrics.select("site_id", F.col("group").alias("label"), shown(1).alias("value"), F.concat_ws(" · ", shown(6), shown(24)).alias("note"))


def ranking(metrics: DataFrame, policy: Policy = RIVER) -> DataFrame:
    unit = F.coalesce("primary_unit", F.lit("ft"))
    rows = ranked(metrics, policy)
    return rows.select("site_id", F.col("group").alias("label"), signed_number(F.col("change_1h"), unit).alias("value"), F.concat(F.col("direction"), F.lit("; 6h "), signed_number(F.col("change_6h"), unit)).alias("note"))


def trends(metrics: DataFrame, observations: DataFrame) -> DataFrame:
    """Points of the stations that have at least two."""
    return observations.where("slot = 'primary'").join(metrics.where("primary_points >= 2").select("site_id", "group"), "site_id").select("site_id", "group", "at", "value")


def select_sites(stations: DataFrame, wanted: str) -> DataFrame:
    """Stations whose name, group or id the text mentions, or all if there is none."""
    text = F.lit(wanted.lower())
    hit = F.contains(text, F.lower("name")) | F.contains(text, F.lower("group")) | F.contains(text, F.lower("site_id"))
    none = stations.agg(F.coalesce(~F.bool_or(hit), F.lit(True)).alias("_none"))  # one row
    return stations.withColumn("_hit", hit).join(F.broadcast(none)).where(F.col("_none") | F.col("_hit")).drop("_hit", "_none")


def ordered_sites(plan: DataFrame, stations: DataFrame) -> DataFrame:
    """Each plan's stations with their place in it: ``plan`` has plan_id and site_ids (array)."""
    wanted = plan.select("plan_id", F.posexplode("site_ids").alias("place", "site_id"))
    return wanted.join(stations, "site_id").orderBy("plan_id", "place")


# The sections that say something about single stations.
NEED_SITES = ("gauge-map", "gauge-table", "stage-trends", "change-windows")


def plan_findings(plans: DataFrame, stations: DataFrame) -> DataFrame:
    """(plan_id, finding, path, subject): everything that keeps a plan from being compiled, with its place in the plan.

    ``plans`` has plan_id, title, audience, framing, site_ids and pages (id, title, description, sections). Sites are looked up
    by one join; everything else is said of a plan's own row. Findings: unknown-site, duplicate-site (of a known site, from
    its second place on), no-known-sites, duplicate-page, duplicate-section, section-needs-sites, free-text-measurement and
    free-text-directive (of any text that readers see).
    """
    place = lambda name, i, rest="": F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"]{rest}"))
    finding = lambda what, path, subject: F.struct(F.lit(what).alias("finding"), path.alias("path"), subject.alias("subject"))
    sites = plans.select("plan_id", "site_ids", F.posexplode("site_ids").alias("i", "subject"))
    met = sites.join(stations.select(F.col("site_id").alias("subject"), F.lit(True).alias("known")).distinct(), "subject", "left")
    again = F.array_position("site_ids", F.col("subject")) <= F.col("i")
    told = F.when(F.col("known").isNull(), "unknown-site").when(again, "duplicate-site")
    of_sites = met.select("plan_id", told.alias("finding"), place("siteIds", F.col("i")).alias("path"), "subject").where("finding IS NOT NULL")

    known = met.groupBy("plan_id").agg(F.count("known").alias("n_known"))
    rows = plans.join(known, "plan_id", "left").withColumn("none", F.coalesce("n_known", F.lit(0)) == 0)
    pages = F.transform("pages", lambda p, i: F.struct(i.alias("i"), p["id"].alias("id"), p["title"].alias("title"), p["description"].alias("description"), p["sections"].alias("sections")))
    repeats = F.filter(pages, lambda p: F.array_position(F.transform("pages", lambda x: x["id"]), p["id"]) <= p["i"])
    parts = F.flatten(F.transform(pages, lambda p: F.transform(p["sections"], lambda x, i: F.struct(F.concat(place("pages", p["i"], ".sections["), i.cast("string"), F.lit("]")).alias("path"), x.alias("kind")))))
    numbered = F.transform(parts, lambda x, i: F.struct(x["path"].alias("path"), x["kind"].alias("kind"), i.alias("i")))
    kinds = F.transform(parts, lambda x: x["kind"])
    texts = F.concat(
        F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).alias("said")) for c in ("title", "audience", "framing")]),
        F.flatten(F.transform(pages, lambda p: F.array(*[F.struct(place("pages", p["i"], f".{c}").alias("path"), p[c].alias("said")) for c in ("title", "description")]))),
    )
    smuggled = lambda what, found: F.flatten(F.transform(texts, lambda x: F.transform(F.coalesce(found(x["said"]), F.array().cast("array<string>")), lambda y: finding(what, x["path"], y))))
    of_plans = F.concat(
        F.filter(F.array(F.when(F.col("none"), finding("no-known-sites", F.lit("siteIds"), F.lit(None).cast("string")))), lambda f: f.isNotNull()),
        F.transform(repeats, lambda p: finding("duplicate-page", place("pages", p["i"], ".id"), p["id"])),
        F.transform(F.filter(numbered, lambda x: F.array_position(kinds, x["kind"]) <= x["i"]), lambda x: finding("duplicate-section", x["path"], x["kind"])),
        F.transform(F.filter(parts, lambda x: F.col("none") & x["kind"].isin(*NEED_SITES)), lambda x: finding("section-needs-sites", x["path"], x["kind"])),
        smuggled("free-text-measurement", measurements), smuggled("free-text-directive", directives),
    )
    return of_sites.unionByName(rows.select("plan_id", F.explode(of_plans).alias("f")).select("plan_id", "f.*"))


def compose(members: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """Components of two or three sources one after the other, ids prefixed by source; an absent source keeps its place."""
    if not 2 <= len(members) <= 3:
        raise ValueError("two or three sources are composed")
    present = [df for _, df in members if df is not None]
    if not present:
        raise ValueError("no source is present")
    spark, parts = present[0].sparkSession, []
    for place, (name, df) in enumerate(members):
        rows = df.select(F.concat(F.lit(f"{name}-"), "id").alias("id"), "kind", "title") if df is not None else spark.range(1).select(F.lit(f"{name}-absent").alias("id"), F.lit("notice").alias("kind"), F.lit("Source unavailable").alias("title"))
        parts.append(rows.withColumn("source", F.lit(place)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("source", "id")
