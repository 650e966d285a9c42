"""Verification of extracted values against stored documents, and reports of the outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalise_number

NORMALISATION_VERSION = "1"
# What each reason for a refusal is about.
REFUSAL_FAMILIES = {
    "unknown-snapshot": "provenance",
    "snapshot-identity-mismatch": "provenance",
    "hash-mismatch": "provenance",
    "locator-out-of-range": "coordinates",
    "coordinate-text-mismatch": "coordinates",
    "malformed-candidate": "contract",
    "unsupported-normalization": "contract",
    "unsupported-unit-syntax": "lexis",
    "value-not-in-extracted-text": "lexis",
    "unit-not-in-extracted-text": "lexis",
}
PROBE = "false-acceptance-probe"


def verify(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with the first reason to refuse them, or null.

    ``candidates``: case_id, snapshot_id, content_sha256, start_byte, end_byte, extracted_text, normalisation, value, unit.
    ``documents``: snapshot_id, sealed_sha256, content (binary).
    """
    sealed = documents.select("snapshot_id", "sealed_sha256", "content", F.sha2("content", 256).alias("actual_sha256"))
    rows = candidates.join(sealed, "snapshot_id", "left").withColumn("number", normalise_number(F.col("extracted_text")))
    at_place = F.decode(F.substring(F.col("content"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")
    needed = ["snapshot_id", "content_sha256", "start_byte", "end_byte", "extracted_text", "normalisation", "value", "unit"]
    malformed = F.greatest(*[F.col(c).isNull() for c in needed]) | (F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte"))
    reason = (
        F.when(malformed, "malformed-candidate")
        .when(F.col("sealed_sha256").isNull(), "unknown-snapshot")
        .when(F.col("content_sha256") != F.col("sealed_sha256"), "snapshot-identity-mismatch")
        .when(F.col("actual_sha256") != F.col("sealed_sha256"), "hash-mismatch")
        .when(F.col("end_byte") > F.octet_length("content"), "locator-out-of-range")
        .when(at_place != F.col("extracted_text"), "coordinate-text-mismatch")
        .when(F.col("normalisation") != NORMALISATION_VERSION, "unsupported-normalization")
        .when(F.col("number.failure") == "unsupported-unit-syntax", "unsupported-unit-syntax")
        .when(F.col("number.failure").isNotNull() | (F.col("number.value") != F.col("value")), "value-not-in-extracted-text")
        .when(F.col("number.unit") != F.col("unit"), "unit-not-in-extracted-text")
    )
    return rows.select(*candidates.columns, reason.alias("refusal"))


def outcomes(verdicts: DataFrame, *by: str, correct: str = "correct", refusal: str = "refusal") -> DataFrame:
    """The two-by-two counts, for all cases or for each value of ``by`` (such as their intent)."""
    right, refused = F.col(correct), F.col(refusal).isNotNull()
    name = F.when(~refused & right, "accepted-and-correct").when(~refused, "accepted-but-wrong").when(right, "refused-though-correct").otherwise("refused-and-wrong")
    return verdicts.groupBy(*by, name.alias("outcome")).agg(F.count(F.lit(1)).alias("cases"))


def refusals(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("refusal IS NOT NULL").groupBy("refusal").agg(F.count(F.lit(1)).alias("cases"))


def probe_report(verdicts: DataFrame) -> DataFrame:
    """One row: accepted, falsely_accepted, false_acceptance_rate, and the kinds of wrongness that probes try and that are refused.

    ``verdicts``: intent, wrongness (null: unclassified), correct, refusal. A class counts as caught if one probe of it is refused.
    """
    accepted = F.col("refusal").isNull()
    probed = F.when(F.col("intent") == PROBE, F.coalesce("wrongness", F.lit("unclassified")))
    counts = verdicts.agg(
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & ~F.col("correct")).alias("falsely_accepted"),
        F.count_distinct(probed).alias("classes_probed"),
        F.count_distinct(F.when(~accepted, probed)).alias("classes_caught"),
    )
    rate = F.when(F.col("accepted") == 0, 0.0).otherwise(F.col("falsely_accepted") / F.col("accepted"))
    return counts.withColumn("false_acceptance_rate", rate)


def strictness_cost(verdicts: DataFrame) -> DataFrame:
    """(family, cases): correct candidates that were refused, by what the refusal is about."""
    families = F.create_map(*[F.lit(x) for pair in REFUSAL_FAMILIES.items() for x in pair])
    lost = verdicts.where(F.col("correct") & F.col("refusal").isNotNull())
    return lost.groupBy(F.try_element_at(families, F.col("refusal")).alias("family")).agg(F.count(F.lit(1)).alias("cases"))
