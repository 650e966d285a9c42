"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and distributed union-find.

A document's set holds the distinct shingles of five words (ASCII lower case, words between ASCII white space); fewer
words make one shingle; documents without words are linked with nothing. Documents are linked when their sets' Jaccard
similarity is 0.75 or more. With 32 bands of 4 slots a pair at exactly 0.75 shares no band with a chance of 5e-6.

Documents with equal sets become one class, with one representative, before anything else. Representatives are linked
within the bands' buckets without listing a bucket's pairs (see set_links): so large groups of copies, or of documents
with a passage in common, make no square of pairs.
Candidates whose signatures agree in too few slots aren't verified; all others are confirmed on the full sets, in the end
word for word.

Defined results: null text or text without words has n_shingles 0 and is its own component; a null doc_id is never the
smallest unless a component has only nulls; of repeated rows one is kept; texts of any length are read whole, in
pieces; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, skew_safe_join
from tidemark.llm.set_links import Agreement, SetLinks, groups
from tidemark.llm.shingles import mix, shingle_sets, super_minhash, word_shingles

BANDS, ROWS = 32, 4
#: A link's signatures agree in fewer of the 128 slots with a chance of 5e-6 (4.4 deviations).
LEAST_AGREEING = 75

_SIGNATURE_FIELDS = [
    pa.field("n_shingles", pa.int64()),
    pa.field("digest", pa.string()),
    pa.field("bands", pa.list_(pa.int64())),
    pa.field("signature", pa.binary()),
]


def _sign(texts: list) -> tuple[list, list, list, list]:
    """n_shingles, digest, bands and signature bytes of each text."""
    sets, offsets = shingle_sets(texts)
    sizes = np.diff(offsets)
    values = super_minhash(sets, offsets, BANDS * ROWS).view(np.uint64)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + values.reshape(-1, BANDS, ROWS)[:, :, r])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(1)), dtype=np.uint64)])
    one = ends[offsets[1:]] - ends[offsets[:-1]]
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(sets) + np.uint64(2)), dtype=np.uint64)])
    two = ends[offsets[1:]] - ends[offsets[:-1]]
    short = (mix(values) >> np.uint64(56)).astype(np.uint8)
    return sizes.tolist(), [f"{n}-{x:016x}{y:016x}" for n, x, y in zip(sizes, one.tolist(), two.tolist())], list(keys), [r.tobytes() for r in short]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("row").field("text").to_pylist()
        parts: list[list] = [[], [], [], []]
        for begin, end in groups(texts):
            for have, more in zip(parts, _sign(texts[begin:end])):
                have.extend(more)
        new = [pa.array(x, f.type) for x, f in zip(parts, _SIGNATURE_FIELDS)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *_SIGNATURE_FIELDS]))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns of ``carry`` (by default doc_id), n_shingles, component_id, kept."""
    carry = [doc_id] if carry is None else carry
    others = [F.col(c) for c in carry if c not in (doc_id, text)]
    named = F.struct(F.col(doc_id).alias("id"), F.col(text).alias("text"), *others)
    base = docs.select(F.monotonically_increasing_id().alias("uid"), named.alias("row"))
    more = T.StructType.fromDDL("n_shingles bigint, digest string, bands array<bigint>, signature binary")
    scratch = Scratch(docs.sparkSession)
    table = scratch.write(base.mapInArrow(_signed, T.StructType([*base.schema, *more])), "near-table")

    keeper = F.min(F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), "uid")).alias("keeper")
    filled = table.where("n_shingles > 0")
    classes = filled.groupBy("digest").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), keeper)
    classes = scratch.write(classes, "near-classes")

    signed = classes.select("node", F.col("n_shingles").alias("weight"), "bands", "signature")
    texts = table.select(F.col("uid").alias("node"), F.col("row.text").alias("text"))
    found = SetLinks(scratch, signed, texts, shingle_sets, word_shingles, Agreement(BANDS * ROWS, LEAST_AGREEING)).components()

    placed = scratch.write(classes.join(found, "node", "left").select("digest", "members", "keeper", F.coalesce("component", "node").alias("component")), "near-placed")
    best = scratch.write(placed.groupBy("component").agg(F.min("keeper").alias("best")), "near-best")  # both written: a hot component is split
    labels = placed.join(best, "component").select("digest", "members", "best").withColumnRenamed("members", "class_rows")
    own = F.when(F.col("n_shingles") == 0, F.concat(F.lit("-"), "uid")).otherwise(F.col("digest"))  # no key for all empty texts
    rows = skew_safe_join(table.select("uid", "row", "n_shingles", own.alias("digest")), labels, "digest", table.count(), "class_rows", how="left")
    return rows.select(
        *[F.col("row.id" if c == doc_id else "row.text" if c == text else f"row.{c}").alias(c) for c in carry],
        "n_shingles",
        F.coalesce(F.col("best.id"), F.when(F.col("best").isNull(), F.col("row.id"))).alias("component_id"),
        (F.col("best").isNull() | (F.col("best.uid") == F.col("uid"))).alias("kept"),
    )
