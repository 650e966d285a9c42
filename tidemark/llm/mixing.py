"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Sources, in code-point order with null last, weigh ``weights`` repeating; they share ``budget`` times all words, no
source above ``ceiling`` times its own words (the excess goes to the others by weight). Each document of a source gets
the whole copies that its rate, target / source_size, allows; they are certain. For the rate's remaining fraction f a
sample of a fixed number of words is drawn with unequal probabilities: a document is included with probability

    p = f + min(f, 1 - f) * (worth - the source's mean worth),    worth = size / (size + HALF_WORTH) in thousandths,

so longer documents, which hold more connected text, are likelier than short ones; weighted by words, p has the mean f
and never leaves [0, 1]. The sample is taken in Pareto order: random odds u / (1 - u) divided by inclusion odds
p / (1 - p), smallest first. Random numbers are digests of a document's id, size and number among rows that repeat
both, so reruns agree.

Nothing is gathered by source: the sample's end is found in a histogram of the order (ORDER_BUCKETS sums a source), then
in one of the bucket that holds it, and only the rows of that one's bucket are sorted.

Defined results: null or wordless text has size 0 and takes 0; a source without words has target 0; null is a source of
its own; repeated rows count as documents of their own; of a text of any length only the number of words is
kept; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch, skew_safe_join, unit_hash, with_global_rank

ORDER_BUCKETS = 4096
#: Words at which a document has half of the highest worth.
HALF_WORTH = 100


def _level(sources: DataFrame, budget_words: float, ceiling: float) -> float:
    """The t for which min(weight * t, ceiling * size) over all sources adds up to the budget."""
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(ceiling)
        capped, open_weight = sources.agg(F.sum(F.when(full, F.col("source_size") * ceiling).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            return level
        higher = (budget_words - capped) / open_weight
        if higher <= level:
            return level
        level = higher


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``nth``, from 1, among the rows that share id and size (nearly always the only one)."""
    key = ["id", "size"]
    repeated = rows.groupBy(*key).count().where("count > 1").drop("count")
    if not repeated.limit(1).count():
        return rows.withColumn("nth", F.lit(1).cast("long"))
    repeated = scratch.write(repeated, "mix-repeated")
    same = [rows[k].eqNullSafe(repeated[k]) for k in key]
    placed = rows.withColumn("line", F.monotonically_increasing_id())  # so a row that fills the table spans many ranges
    again = with_global_rank(placed.join(repeated, same, "left_semi"), [F.col(k) for k in (*key, "line")], "place").drop("line")
    again = scratch.write(again, "mix-again")
    first = scratch.write(again.groupBy(*key).agg(F.min("place").alias("first")), "mix-first")
    same = [again[k].eqNullSafe(first[k]) for k in key]
    again = again.join(first, same).select(*[again[c] for c in rows.columns], (F.col("place") - F.col("first") + 1).alias("nth"))
    return rows.join(repeated, [rows[k].eqNullSafe(repeated[k]) for k in key], "left_anti").withColumn("nth", F.lit(1).cast("long")).unionByName(again)


def _bucket(order: Column) -> Column:
    """The bucket of a number from 0 to 1."""
    return F.least(F.floor(order * ORDER_BUCKETS), F.lit(ORDER_BUCKETS - 1))


def _end(ranked: DataFrame, bucket: str, name: str) -> DataFrame:
    """For each source the bucket in which its running words reach ``wanted`` (less ``done``), and the words before it."""
    sums = ranked.groupBy("source_key", bucket).agg(F.sum("size").alias("words"), F.max("wanted").alias("wanted"), F.max("done").alias("done"))
    running = sums.withColumn("until", F.col("done") + F.sum("words").over(Window.partitionBy("source_key").orderBy(bucket)))
    ends = running.where("until >= wanted and until - words < wanted")
    return ends.select("source_key", F.col(bucket).alias(f"{name}_bucket"), (F.col("until") - F.col("words")).alias(f"{name}_done"))


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", carry: list[str] | None = None, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, ceiling: float = 2.0, seed: str = "mix-2") -> DataFrame:
    """One row per document: the columns of ``carry`` (by default doc_id), size, source_size, target, copies, taken."""
    carry = [doc_id] if carry is None else carry
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*carry).alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("source_key"), size.alias("size"))
    rows = _numbered(scratch.write(rows, "mix-sizes"), scratch)
    worth = F.floor(F.lit(1000.0) * F.col("size") / (F.col("size") + HALF_WORTH)).cast("long")
    slim = rows.withColumn("u", unit_hash(F.lit(seed), F.col("id"), F.col("size"), F.col("nth"))).withColumn("worth", worth)

    # Keys are "s" + source, or "t" for null: code-point order with null last.
    sources = slim.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"), F.sum(F.col("worth") * F.col("size")).alias("worth_words"))
    sources = with_global_rank(sources, [F.col("source_key").asc()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = scratch.write(sources.withColumn("weight", weight), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    n_rows = sources.agg(F.coalesce(F.sum("source_rows"), F.lit(0))).first()[0]
    level = _level(sources.where("source_size > 0"), budget * total, ceiling) if total else 0.0
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(ceiling))
    filled = F.col("source_size") > 0
    sources = sources.withColumn("target", target).withColumn("rate", F.when(filled, F.col("target") / F.col("source_size")).otherwise(0.0))
    sources = sources.withColumn("sure", F.floor("rate")).withColumn("part", F.col("rate") - F.col("sure"))
    sources = sources.withColumn("wanted", F.col("target") - F.col("sure") * F.col("source_size"))
    sources = sources.withColumn("mean_worth", F.when(filled, F.col("worth_words") / F.col("source_size")).otherwise(0.0))
    sources = sources.select("source_key", "source_rows", "source_size", "target", "sure", "part", "wanted", "mean_worth")

    p = F.col("part") + F.least(F.col("part"), 1 - F.col("part")) * ((F.col("worth") - F.col("mean_worth")) / F.lit(1000.0))
    odds = F.when(F.col("part") > 0, F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p")))

    def ordered(ends: DataFrame) -> DataFrame:
        """The rows with the facts of their sources, their place ``order`` from 0 to 1, and its bucket."""
        ranked = skew_safe_join(slim, ends, "source_key", n_rows, "source_rows").withColumn("p", p).withColumn("odds", odds)
        ranked = ranked.withColumn("order", F.col("odds") / (1 + F.col("odds"))).withColumn("bucket", _bucket(F.col("order")))
        return ranked.withColumn("inner_bucket", _bucket(F.col("order") * ORDER_BUCKETS - F.col("bucket")))

    drawn = F.col("order").isNotNull() & (F.col("size") > 0)
    end = _end(ordered(sources).where(drawn).withColumn("done", F.lit(0)), "bucket", "end")
    sources = scratch.write(sources.join(end, "source_key", "left"), "mix-ends")
    at_end = F.coalesce(drawn & (F.col("bucket") == F.col("end_bucket")), F.lit(False))
    inner = _end(ordered(sources).where(at_end).withColumn("done", F.col("end_done")), "inner_bucket", "inner_end")
    sources = scratch.write(sources.join(inner, "source_key", "left"), "mix-inner-ends")

    ranked = ordered(sources)
    at_end = F.coalesce(at_end & (F.col("inner_bucket") == F.col("inner_end_bucket")), F.lit(False))
    inside = Window.partitionBy("source_key").orderBy("odds", "id", "size", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ranked.where(at_end).withColumn("before", F.col("inner_end_done") + F.sum("size").over(inside) - F.col("size"))
    edge = edge.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("wanted")).cast("int")).drop("before")
    sooner = (F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & (F.col("inner_bucket") < F.col("inner_end_bucket")))
    sampled = drawn & (F.col("end_bucket").isNull() | sooner)
    clear = ranked.where(~at_end).withColumn("extra", F.coalesce(sampled, F.lit(False)).cast("int"))
    copies = (F.col("sure") + F.col("extra")).cast("int")
    return clear.unionByName(edge).select("row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
