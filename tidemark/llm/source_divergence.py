"""Source divergence audit: how far the word distributions of a language's sources lie apart, and which terms part them.

* Counting runs in Arrow compute inside mapInArrow: ascii_lower, split_pattern_regex, dictionary_encode, then hash group_by,
  first by document and term, then by (language, source) and term. A task keeps one table of partial counts, grouped anew
  as it grows, and emits it when it is full and at its end.
* Spark adds the partial counts. Terms in at least LEAST_DOCS documents of a language are kept.
* The kept counts of a language are dealt into shards by term, each of about CELLS cells (terms times sources), so no shard
  grows with the corpus. A shard holds all counts of its terms, so divergences are summed over terms within it, in columns,
  and its sums and its ten largest terms of each source are merged.

All arithmetic is on whole numbers. Shares are p = 1 + floor(10**9 * (count + 2) / (N + 2V)), exact for counts up to 9e13.

Defined results: null text, lang or source count as empty texts; a source without terms takes part in pairs, with all
counts 0; a language without kept terms has pairs of value 0; a language with one source has no rows; long texts are cut
between terms and counted whole; repeated rows are documents each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

LEAST_DOCS, TOP = 10, 10
#: Terms are runs of ASCII letters and of everything beyond ASCII; texts are split at the rest.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:65] = _SEPARATOR[91:97] = _SEPARATOR[123:128] = True
#: Text bytes that are split at a time, rows of a task's table of partial counts, and cells of a shard.
SLICE, HELD, CELLS = 1 << 23, 1 << 20, 1 << 16
SHARE = 1_000_000_000


# --- partial counts ----------------------------------------------------------------------------------------------------


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text of about SLICE bytes, cut between terms (a longer term is never cut)."""
    at = 0
    while len(text) - at > SLICE:
        ahead, cut = SLICE, 0
        while not cut and at + ahead < len(text):
            gaps = np.flatnonzero(_SEPARATOR[np.frombuffer(text, np.uint8, ahead, at)])
            cut, ahead = (int(gaps[-1]) + 1 if len(gaps) else 0), min(2 * ahead, len(text) - at)
        if not cut:
            break
        yield text[at : at + cut]
        at += cut
    yield text[at:]


def _by_document(docs: pa.Array, texts: pa.Array) -> pa.Table:
    """(doc, term, n) of texts, ``docs`` naming the document of each."""
    terms = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    owner, flat = docs.take(pc.list_parent_indices(terms)), pc.list_flatten(terms)
    there = pc.not_equal(flat, "")
    table = pa.table({"doc": owner.filter(there), "term": flat.filter(there).dictionary_encode()})
    found = table.group_by(["doc", "term"]).aggregate([([], "count_all")])
    return pa.table({"doc": found["doc"], "term": found["term"], "n": found["count_all"]})


def _slices(texts: pa.Array) -> Iterator[pa.Table]:
    """(doc, term, n) of ranges of the texts of about SLICE bytes; a longer text makes one of its own."""
    sizes = pc.binary_length(texts).to_numpy()
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held + size > SLICE and i > begin:
            yield _by_document(pa.array(range(begin, i), pa.int64()), texts.slice(begin, i - begin))
            begin, held = i, 0
        if size > SLICE:
            parts = [_by_document(pa.array([i], pa.int64()), pa.array([p.decode("utf-8")], pa.large_string())) for p in _pieces(texts[i].as_buffer().to_pybytes())]
            whole = pa.concat_tables([p.set_column(1, "term", p["term"].cast(pa.large_string())) for p in parts]).group_by(["doc", "term"]).aggregate([("n", "sum")])
            yield whole.rename_columns(["doc", "term", "n"])
            begin, held = i + 1, 0
        else:
            held += size
    if begin < len(texts):
        yield _by_document(pa.array(range(begin, len(texts)), pa.int64()), texts.slice(begin))


_KEYS = ["lang", "source", "term"]


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*_KEYS, "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, source, term, n, docs). An empty term stands for the group itself."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        lang, source, text = (pc.fill_null(batch.column(c).cast(pa.large_string()), "") for c in ("lang", "source", "text"))
        n = batch.num_rows
        held.append(pa.table({"lang": lang, "source": source, "term": pa.array([""] * n, pa.large_string()), "n": pa.array([0] * n, pa.int64()), "docs": pa.array([1] * n, pa.int64())}))
        for found in _slices(text):
            doc = found["doc"].combine_chunks()
            terms = pa.table({"lang": lang.take(doc), "source": source.take(doc), "term": found["term"].cast(pa.large_string()), "n": found["n"], "docs": pa.array(np.ones(len(doc), np.int64))})
            held.append(_merged([terms]))
            rows += len(held[-1])
            if rows > HELD:
                held = [_merged(held)]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from held[0].combine_chunks().to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from _merged(held).combine_chunks().to_batches(1 << 16)


# --- divergences of a shard ------------------------------------------------------------------------------------------


def shares(counts: np.ndarray, total, kept) -> np.ndarray:
    """1 + floor(SHARE * (count + 2) / (total + 2 * kept)) of 64-bit whole numbers, by two steps of a long division."""
    whole = total + 2 * kept
    high, rest = np.divmod((counts + 2) * 100_000, whole)
    return 1 + high * 10_000 + rest * 10_000 // whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_PARTS = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())])


def _diverging(key: tuple, cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Of one shard of a language's kept terms: sums for each ordered pair of sources, and each source's largest terms."""
    lang, n_sources = key[0].as_py(), len(sources)
    if not n_sources:
        raise ValueError("a shard without sources")
    order = pc.sort_indices(sources["source"])
    names, totals = sources["source"].take(order).combine_chunks(), sources["total"].take(order).to_numpy()
    kept = sources["kept"][0].as_py()
    terms = cells["term"].combine_chunks().dictionary_encode()
    row, column = pc.index_in(cells["source"].combine_chunks(), names).to_numpy(), terms.indices.to_numpy()
    counts = np.zeros((n_sources, len(terms.dictionary)), np.int64)
    np.add.at(counts, (row, column), cells["n"].to_numpy())
    p = shares(counts, totals[:, None], kept) if counts.size else counts
    out: list[tuple] = []
    for i in range(n_sources):
        sums = apart(p[i], p).sum(axis=1).tolist()
        out += [(i, "pair", names[k].as_py(), sums[k]) for k in range(n_sources) if k != i]
    q = shares(counts.sum(axis=0), int(totals.sum()), kept) if counts.size else counts
    said = [t.encode("utf-8") for t in terms.dictionary.to_pylist()]
    for i in range(n_sources if counts.size else 0):
        more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        value = apart(p[i][more], q[more])
        if len(more) > TOP:  # ties at the last place stay
            least = np.partition(value, -TOP)[-TOP]
            more, value = more[value >= least], value[value >= least]
        best = sorted(zip((-value).tolist(), [said[k] for k in more]))[:TOP]
        out += [(i, "term", t.decode("utf-8"), -v) for v, t in best]
    place, part, item, value = zip(*out) if out else ((), (), (), ())
    columns = [[lang] * len(out), names.take(pa.array(place, pa.int64())).to_pylist(), part, item, value]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PARTS)], schema=_PARTS)


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source, ``term`` rows for each source's ten telling terms."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = named.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = scratch.write(partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    groups = counts.where("term = ''").select("lang", "source")
    frequent = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term")
    cells = scratch.write(counts.where("term <> ''").select(*_KEYS, "n").join(frequent, ["lang", "term"]), "kept-counts")

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    width = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("wide"))
    kept = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    height = F.greatest(F.col("wide"), F.ceil(F.lit(CELLS) / F.col("wide")))  # terms of a shard
    langs = width.join(kept, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / height)).cast("int").alias("shards"))
    langs = scratch.write(langs, "langs")
    listed = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    dealt = cells.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n")
    parts = dealt.groupBy("lang", "shard").cogroup(listed.groupBy("lang", "shard")).applyInArrow(_diverging, "lang string, source string, part string, item string, value bigint")
    parts = scratch.write(parts, "shard-parts")

    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = parts.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", place).unionByName(top).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
