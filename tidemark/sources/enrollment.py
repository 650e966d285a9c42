"""Annual enrollment tables from campus-facts HTML pages, and their shares and changes.

``enrollment_findings`` reads any number of pages, sound or not: cells become rows with their places, years are compared by a
window of each page, sums by a grouping of each column, and the figures of the prose are found by a join with the table's.
``enrollment_history`` has the years of the sound pages. ``parse_enrollment`` fails at the first unsound page instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import WHOLE, magnitude
from tidemark.functions.text import format_number
from tidemark.session import with_checkpoints
from tidemark.sources.tables_html import first_element, plain_text, table_cells


# The largest page, the rows, what the counts mean, and the section's bounds.
MAX_BYTES = 1_000_000
LABELS = {"Undergraduate Enrollment": "undergraduate", "Graduate Enrollment": "graduate", "Total Enrollment": "total"}
DEFINITION = "Counts represent distinct students who are enrolled in credit-bearing classes as of the fall third-week census."
_SECTION = r"""(?is)\bid=["']enrollment["'](.*?)\bid=["']student-demographics["']"""


def _number(text: Column) -> Column:
    """A count as printed, with or without commas between groups of three."""
    return F.when(F.rlike(text, F.lit(r"^(\d+|\d{1,3}(,\d{3})+)\z")), F.replace(text, F.lit(","), F.lit(""))).try_cast("bigint")


def _percent(part: str, whole: str) -> Column:
    """A share of counts in percent with one decimal, exact, ties away from zero; null for a whole of 0.

    A quotient of doubles lies on either side of a tie that the counts hold exactly.
    """
    twice = (F.nullif(F.col(whole), F.lit(0)).cast("decimal(20,0)") * 2).cast(WHOLE)
    above = (magnitude(F.col(part)) * 2000).cast(WHOLE) + F.col(whole)
    tenths = ((above - above % twice) / twice).cast("double") / 10
    return F.when(F.col(part) < 0, -tenths).otherwise(tenths)


def enrollment_pages(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, large, has_section, has_definition, term, overview, table_html): the parts of each page; null what a page lacks or is too large for."""
    large = F.coalesce(F.octet_length(html) > MAX_BYTES, F.lit(False))
    section = F.try_element_at(F.regexp_extract_all(F.when(~large, F.col(html)), F.lit(_SECTION), F.lit(1)), F.lit(1))
    found = pages.select(key, large.alias("large"), section.alias("section"))
    heading = plain_text(first_element(F.col("section"), "h4"))
    overview = F.try_element_at(F.regexp_extract_all("section", F.lit(r"(?is)<h5\b[^>]*>\s*Overview\s*</h5>\s*<p\b[^>]*>(.*?)</p>"), F.lit(1)), F.lit(1))
    term = F.regexp_extract(heading, r"^Enrollment - Fall (\d{4})\z", 1).try_cast("int")
    defined = F.contains(plain_text(F.col("section")), F.lit(DEFINITION)).alias("has_definition")
    return found.select(key, "large", F.col("section").isNotNull().alias("has_section"), defined, term.alias("term"), plain_text(overview).alias("overview"), first_element(F.col("section"), "table").alias("table_html"))


def _table(parts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cells, figures): all cells with their row's label, and (key, column, year, undergraduate, graduate, total)."""
    cells = table_cells(parts, key=key)
    label = F.max(F.when(F.col("column") == 0, F.col("text"))).over(Window.partitionBy(key, "row"))
    labelled = cells.repartition(key).withColumn("label", F.when(F.col("row") > 0, label)).checkpoint()  # one exchange serves all that follows
    value = lambda name: F.max(F.when(F.col("label") == name, _number(F.col("text"))))
    year = F.max(F.when(F.col("row") == 0, F.col("text").try_cast("int"))).alias("year")
    figures = labelled.where("column > 0").groupBy(key, "column").agg(year, *[value(n).alias(c) for n, c in LABELS.items()])
    return labelled, figures


def enrollment_findings(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, problem, subject): what keeps each page from being read; a sound page has no row."""
    with_checkpoints(pages.sparkSession)
    parts = enrollment_pages(pages, html, key).checkpoint()
    cells, figures = _table(parts, key)
    say = lambda rows, problem, subject=None: rows.select(key, F.lit(problem).alias("problem"), (F.lit(None) if subject is None else F.col(subject)).cast("string").alias("subject"))
    has = F.col("has_section")
    found = say(parts.where("large"), "too-large").union(say(parts.where(~F.col("large") & ~has), "no-section"))
    found = found.union(say(parts.where(has & F.col("term").isNull()), "no-heading")).union(say(parts.where(has & F.col("table_html").isNull()), "no-table"))
    in_term = F.contains("overview", F.concat(F.lit("In the Fall "), F.col("term").cast("string"), F.lit(" term")))
    found = found.union(say(parts.where(F.col("term").isNotNull() & ~F.coalesce(in_term, F.lit(False))), "overview-term"))
    found = found.union(say(parts.where(has & ~F.col("has_definition")), "no-definition"))

    shape = cells.groupBy(key).agg((F.max("row") + 1).alias("rows"), F.count_if(F.col("row") == 0).alias("wide"))
    found = found.union(say(shape.where("rows <> 4"), "row-count", "rows")).union(say(shape.where("wide < 3"), "few-years"))
    widths = cells.groupBy(key, "row").agg(F.count(F.lit(1)).alias("cells"), F.max("label").alias("label")).join(shape, key)
    found = found.union(say(widths.where("cells <> wide"), "row-width", "row"))
    labels = widths.where("row > 0")
    unknown = labels.where(F.col("label").isNull() | ~F.col("label").isin(*LABELS))
    again = labels.groupBy(key, "label").count().where("count > 1")
    named = labels.groupBy(key).agg(F.collect_set(F.when(F.col("label").isin(*LABELS), F.col("label"))).alias("there"))
    lacking = named.select(key, F.explode(F.array_except(F.array(*[F.lit(x) for x in LABELS]), "there")).alias("label"))
    found = found.union(say(unknown, "unknown-row", "label")).union(say(again, "repeated-row", "label")).union(say(lacking, "missing-row", "label"))
    bad = cells.where((F.col("row") > 0) & (F.col("column") > 0) & _number(F.col("text")).isNull())
    found = found.union(say(bad, "bad-number", "text")).union(say(cells.where((F.col("row") == 0) & (F.col("column") > 0) & F.col("text").try_cast("int").isNull()), "bad-year", "text"))

    before = F.lag("year").over(Window.partitionBy(key).orderBy("column"))
    found = found.union(say(figures.withColumn("before", before).where("year <= before"), "years-fall", "year"))
    found = found.union(say(figures.where("undergraduate + graduate <> total"), "arithmetic", "year"))
    latest = figures.groupBy(key).agg(F.max_by(F.struct("year", *LABELS.values()), "column").alias("f")).select(key, "f.*")
    met = latest.join(parts.select(key, "term", "overview"), key)
    found = found.union(say(met.where("year <> term"), "heading-year", "year"))
    share = lambda part: F.when(_percent(part, "total").isNotNull(), F.concat(F.format_string("%.1f", _percent(part, "total")), F.lit("%")))
    count = lambda c: F.when(F.col(c).isNotNull(), format_number(F.col(c).cast("double")))
    printed = F.array(*[count(c) for c in LABELS.values()], share("undergraduate"), share("graduate"))
    told = met.select(key, "overview", F.explode(printed).alias("figure")).where("figure IS NOT NULL")
    return found.union(say(told.where(~F.coalesce(F.contains("overview", F.col("figure")), F.lit(False))).distinct(), "overview-figure", "figure"))


def enrollment_history(pages: DataFrame, found: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, year, undergraduate, graduate, total) of the pages without a finding."""
    with_checkpoints(pages.sparkSession)
    sound = pages.join(found.select(key).distinct(), key, "left_anti")
    return _table(enrollment_pages(sound, html, key), key)[1].drop("column")


def _must(condition: Column, message: str, value: Column, kind: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(f"enrollment page: {message}")).cast(kind))


def parse_enrollment(pages: DataFrame, html: str = "html") -> DataFrame:
    """(year, undergraduate, graduate, total), from the enrollment section's table: a header of years and a row for each."""
    section = F.regexp_extract(html, r"""(?is)\bid=["']enrollment["'](.*?)\bid=["']student-demographics["']""", 1)
    table = F.regexp_extract(section, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<(?:th|td)\b[^>]*>(.*?)</(?:th|td)>"), F.lit(1)), plain_text))
    found = pages.select(_must(F.size(cells) == 4, "a header and three rows are wanted", cells, "array<array<string>>").alias("c"))
    number = lambda x: F.regexp_replace(x, ",", "").cast("int")
    row = lambda name: F.transform(F.slice(F.try_element_at(F.filter("c", lambda r: F.lower(r[0]).startswith(name)), F.lit(1)), 2, 1000), number)
    years = F.transform(F.slice(F.col("c")[0], 2, 1000), number)
    long = found.select(F.explode(F.arrays_zip(years.alias("year"), row("undergraduate").alias("undergraduate"), row("graduate").alias("graduate"), row("total").alias("total"))).alias("r")).select("r.*")
    return long.withColumn("total", _must(F.col("undergraduate") + F.col("graduate") == F.col("total"), "the rows don't add up", F.col("total"), "int"))


def enrollment_changes(history: DataFrame, key: str | None = None) -> DataFrame:
    """Shares and change from the year before, in percent with one decimal, of one page or of each ``key``."""
    by = [key] if key else []
    before = F.lag("total").over(Window.partitionBy(*by).orderBy("year"))  # a page has one row a year
    rows = history.withColumn("before", before).withColumn("more", F.col("total") - F.col("before"))
    return rows.select(*by, "year", "total", _percent("undergraduate", "total").alias("undergraduate_share"), _percent("graduate", "total").alias("graduate_share"), _percent("more", "before").alias("year_change"))
