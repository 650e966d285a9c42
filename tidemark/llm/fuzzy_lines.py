"""Fuzzy line de-duplication by MinHash of character shingles.

A line is compared without surrounding blanks and in lower case; its set holds the distinct shingles of SHINGLE
characters (a shorter line is one shingle). Lines are linked when their sets' Jaccard similarity is 0.75 or more, and one
line of each component stays: the first by doc_id and line number.

* Equal lines become one class before anything else.
* The signature is a one-permutation MinHash of all shingles of a line, in BANDS bands of ROWS slots. A pair at 0.75
  shares no band with a chance of 5e-4.
* Classes are linked within the bands' buckets without listing a bucket's pairs, by the exact similarity of full sets (see
  set_links), and joined by distributed union-find.

Signatures and sets are made in numpy inside the tasks, their agreement is counted in built-in functions. Built-in functions
can express the rest too, and did, but not within the limits of CPU time (see README).

Defined results: null text is one empty line; empty lines are never compared and all stay; a null doc_id is last in
order; of repeated rows one stays; a line of any length is compared whole; an empty table gives an empty result; other
columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, skew_safe_join
from tidemark.llm.set_links import Agreement, SetLinks, groups
from tidemark.llm.shingles import character_sets, character_shingles, line_shingles, mix, one_permutation_minhash

SHINGLE = 10
BANDS, ROWS = 14, 3
#: A link's signatures agree in fewer of the 42 slots with a chance of 1e-6 (5 deviations), where both lines have TELLS_FROM
#: characters. The slots of a shorter line borrow from each other: in the worst case, sets of 3 and 4 shingles, the odd one
#: must take 41 of the 42 slots for less than LEAST_SMALL to agree, which has a chance of (2 / 42)**3, or 1e-4.
LEAST_AGREEING, LEAST_SMALL, TELLS_FROM = 17, 2, 120
_BLANKS = " \t\x0b\x0c\r"


def _stripped(line: Column) -> Column:
    """``line`` without blanks at its ends. btrim looks at every character, so it gets only the lines that have some."""
    blank = [at(b) for b in _BLANKS for at in (line.startswith, line.endswith)]
    return F.when(reduce(Column.__or__, blank), F.btrim(line, F.lit(_BLANKS))).otherwise(line)


def _key() -> Column:
    return F.unhex(F.md5("line"))


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    parts = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    parts = parts.withColumn("line", F.lower(_stripped(F.col("line"))))
    return parts.withColumn("key", F.when(F.length("line") > 0, _key()))


def _sign(lines: list[str]) -> tuple[np.ndarray, list]:
    """Bands and signature bytes of each line, which has at least one character."""
    hashes, owners = character_shingles(lines, SHINGLE)
    values = one_permutation_minhash(hashes, owners, len(lines), BANDS * ROWS)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + values.reshape(-1, BANDS, ROWS)[:, :, r])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    return keys, [r.tobytes() for r in (values >> np.uint64(56)).astype(np.uint8)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column("line").to_pylist()
        for begin, end in groups(lines):
            keys, signature = _sign(lines[begin:end])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            node = batch.column("node").slice(begin, end - begin)
            weight = pa.array([len(x) for x in lines[begin:end]], pa.int64())
            yield pa.RecordBatch.from_arrays([node, weight, bands, pa.array(signature, pa.binary())], names=["node", "weight", "bands", "signature"])


def fuzzy_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line: doc_id, line_no, component_doc_id, component_line_no, kept."""
    scratch = Scratch(docs.sparkSession)
    cut = _lines(docs, text, doc_id)
    lines = scratch.write(cut.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "line_no", "key"), "lines")

    distinct = cut.where(F.length("line") > 0).select("line").distinct()
    classes = scratch.write(distinct.select(F.monotonically_increasing_id().alias("node"), _key().alias("key"), "line"), "line-classes")
    signed = scratch.write(classes.select("node", "line").mapInArrow(_signed, "node bigint, weight bigint, bands array<bigint>, signature binary"), "line-signed")
    texts = classes.select("node", F.col("line").alias("text"))
    found = SetLinks(scratch, signed, texts, lambda lines: character_sets(lines, SHINGLE), lambda line: line_shingles(line, SHINGLE), Agreement(BANDS * ROWS, LEAST_AGREEING, LEAST_SMALL, TELLS_FROM)).components()

    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "uid")).alias("keeper")
    counted = scratch.write(lines.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("class_rows"), keeper), "line-counts")
    placed = scratch.write(classes.select("node", "key").join(found, "node").join(counted, "key").select("key", "component", "keeper"), "line-placed")
    best = scratch.write(placed.groupBy("component").agg(F.min("keeper").alias("best")), "line-best")
    labelled = counted.join(placed.join(best, "component").select("key", "best"), "key", "left").select("key", "class_rows", F.coalesce("best", "keeper").alias("best"))
    own = F.coalesce("key", F.concat(F.lit("-"), F.col("uid")).cast("binary"))  # no key for all empty lines
    rows = skew_safe_join(lines.select("uid", "doc_id", "line_no", own.alias("key")), labelled, "key", lines.count(), "class_rows", how="left")
    alone = F.col("best").isNull()
    return rows.select(
        "doc_id",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("best.line_no")).alias("component_line_no"),
        (alone | (F.col("best.uid") == F.col("uid"))).alias("kept"),
    )
