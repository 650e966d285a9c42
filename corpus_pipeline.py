"""The corpus pipeline: language ID, exact de-duplication, near de-duplication, mixing and packing of documents.

In every stage: an empty table gives an empty one; texts are read whole, however long; columns of any name pass by,
whatever names a stage uses itself; nulls in them stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import UNDETERMINED, fit_language_id, identify_language
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack

#: A document whose best language has less than this probability is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.4


#: Columns that stages use by name; all others pass through under names that clash with none of a stage's own.
KNOWN = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """Documents with their other columns renamed, and the columns that undo it."""
    names = {c: c if c in KNOWN else f"_other{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: null, empty and letterless texts, and unsure ones.

    Nothing is rejected for its lang, which may be null; without any labelled text every document is rejected. Repeated
    rows are judged alike.
    """
    docs, back = _apart(docs)
    told = identify_language(docs, fit_language_id(docs), carry=docs.columns)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*back)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the longest as written, of ties the one with the smallest doc_id.

    Null and empty texts are equal; a null doc_id loses ties; of rows that repeat doc_id and text exactly one stays.
    """
    docs, back = _apart(docs)
    return exact_dedup(docs, carry=docs.columns).where("kept").select(*back)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id.

    Documents without words all stay; a null doc_id is never the smallest unless a group has only nulls; of repeated rows
    one stays.
    """
    docs, back = _apart(docs)
    return near_dedup(docs, carry=docs.columns).where("kept").select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix of sources takes them, at most two copies of each.

    A null source is a source of its own; documents without words have no size, and go or stay with their source's whole
    copies; repeated rows are documents of their own.
    """
    docs, back = _apart(docs)
    taken = mix_sources(docs, carry=docs.columns).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences: of each copy of each document, null texts counting as empty."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("packing", packing)]

#: Not expressible in SQL (language ID); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
