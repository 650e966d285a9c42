"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with item-sized windows of documents.

A window holds WINDOW consecutive words of a benchmark item (an item of fewer words is one window). Its elements are its
shingles of SHINGLE words (a shorter window is one shingle), and a document contains it where as many consecutive words
are the same.

1. Benchmark shingles are counted over all documents, which puts each window's shingles in order of rarity.
2. As all k shingles of a window must be there, its necessary prefix is k - k + 1 = 1 shingle, its rarest: only that one is
   joined. A window with a shingle that no document has is out.
3. A document's shingles pass a bit table of prefix shingles (hashes, of a fixed size at most) before anything is shuffled;
   those that do carry the words around them, as far as the document goes. So a match must lie within the document (length
   bound) and begin just the shingle's offset before it (positional bound).
4. Each match is verified on the words themselves, never on hashes.

Defined results: null or wordless texts and items match nothing; a null item_id is an item named "null", rows with one
item_id are one item; documents of any length are read whole; rows that repeat a document are judged each; an empty table
on either side gives no hits; other columns pass by (``carry``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.shingles import mix

WINDOW, SHINGLE = 10, 5
#: Text bytes in which words are looked for at a time.
PIECE = 1 << 20
#: The bit table has about so many bits for each shingle, and no more than 2**MOST_BITS (16 MB).
BITS_EACH, MOST_BITS = 16, 27
#: Bits of a block of the table, as Spark's bitmap functions have it.
_BLOCK = 1 << 15
_OUT_ROWS = 1 << 14
_FACTOR = 0x9E3779B97F4A7C15
# Words are ASCII letters (lower case) and digits and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end between words (a longer word is never cut)."""
    at = 0
    while len(data) - at > PIECE:
        ahead, cut = PIECE, 0
        while not cut and at + ahead < len(data):
            gaps = np.flatnonzero(~_WORD[np.frombuffer(data, np.uint8, ahead, at)])
            cut, ahead = (int(gaps[-1]) + 1 if len(gaps) else 0), min(2 * ahead, len(data) - at)
        if not cut:
            break
        yield at, at + cut
        at += cut
    yield at, len(data)


def _piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(offsets[-1] + sizes[-1]) - np.repeat(offsets, sizes)
    letters = mix(raw[inside].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
    return starts, ends, mix(np.add.reduceat(letters, offsets) + sizes.astype(np.uint64))


class Words:
    """The words of several texts: where they start and end in ``data``, their hashes, and the text that each is of."""

    def __init__(self, texts: list):
        encoded = [(t or "").encode("utf-8").lower() for t in texts]
        self.data = b"\0".join(encoded)
        parts = []
        for begin, end in _cuts(self.data):
            starts, ends, hashes = _piece_words(np.frombuffer(self.data, np.uint8, end - begin, begin))
            parts.append((starts + begin, ends + begin, hashes))
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts))
        begins = np.cumsum([0, *[len(e) + 1 for e in encoded]])[:-1]
        self.owner = np.searchsorted(begins, self.starts, "right") - 1
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places (first words) and hashes of all shingles of ``size`` words."""
        n = max(0, len(self.hashes) - size + 1)
        inside = np.flatnonzero(self.owner[:n] == self.owner[size - 1 : size - 1 + n])
        found = np.zeros(len(inside), np.uint64)
        for k in range(size):
            found += self.hashes[inside + k] * np.uint64(pow(_FACTOR, k + 1, 1 << 64))
        return inside, mix(found + np.uint64(size))

    def said(self, begin: int, end: int) -> str:
        return b" ".join([self.data[a:b] for a, b in zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist())]).decode("utf-8")


def _grouped(texts: list) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= PIECE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _windows(window: int, shingle: int):
    kinds = pa.schema([("item", pa.string()), ("window", pa.string()), ("size", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = batch.column("item").to_pylist(), batch.column("text").to_pylist()
            held = []
            for item, text in zip(items, texts):
                words = Words([text])
                n = len(words.starts)
                if not n:
                    continue
                tokens = words.shingles(min(shingle, n))[1].view(np.int64)
                each = min(window, n) - min(shingle, n) + 1
                for begin in range(max(1, n - window + 1)):
                    held.append({"item": item, "window": words.said(begin, begin + window), "size": min(window, n), "tokens": tokens[begin : begin + each]})
                    if len(held) == _OUT_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held = []
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return windows


class BitTable:
    """A set of hashes as bits at the hashes' low ends, of a size that has a fixed bound. It may say yes wrongly, never no."""

    def __init__(self, tokens: DataFrame, count: int):
        self.bits = 1 << min(MOST_BITS, max(15, math.ceil(math.log2(max(1, count) * BITS_EACH))))
        place = F.col("token").bitwiseAND(F.lit(self.bits - 1)) + 1
        blocks = tokens.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 4,096 of 4 KB at most
        self.table = np.zeros(self.bits // 8, np.uint8)
        for row in blocks:
            at = (row.block - 1) * _BLOCK // 8
            self.table[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(self.bits - 1)
        return (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counted(table: BitTable, sizes: list[int]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), []
            for begin, end in _grouped(texts):
                words = Words(texts[begin:end])
                for size in sizes:
                    tokens = words.shingles(size)[1]
                    found.append(tokens[table.has(tokens)])
            tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return counted


_FOUND = "token bigint, place bigint, lead int, around string"


def _candidates(table: BitTable, sizes: list[int], window: int):
    """A row for each document (doc, n_words) and one for each shingle that may be a prefix, with the words around it."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, kinds = batch.column("doc"), [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            names = ["uid", "doc", "n_words", "token", "place", "lead", "around"]
            uids, texts, n_words = batch.column("uid").to_pylist(), batch.column("text").to_pylist(), []
            held: list[tuple] = []

            def flushed() -> pa.RecordBatch:
                uid, *found = zip(*held)
                out = [pa.array(uid, pa.int64()), pa.nulls(len(held), doc.type), pa.nulls(len(held), pa.int64()), *[pa.array(x, k) for x, k in zip(found, kinds)]]
                held.clear()
                return pa.RecordBatch.from_arrays(out, names=names)

            for begin, end in _grouped(texts):
                words = Words(texts[begin:end])
                n_words.append(np.diff(words.first))
                for size in sizes:
                    places, tokens = words.shingles(size)
                    hit = table.has(tokens)
                    for p, token in zip(places[hit].tolist(), tokens[hit].view(np.int64).tolist()):
                        o = words.owner[p]
                        low = max(words.first[o], p - window + size)
                        held.append((uids[begin + o], token, p - words.first[o], p - low, words.said(low, min(p + window, words.first[o + 1]))))
                        if len(held) == _OUT_ROWS:
                            yield flushed()
            if held:
                yield flushed()
            counts = pa.array(np.concatenate([np.zeros(0, np.int64), *n_words]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), doc, counts, *[pa.nulls(len(uids), k) for k in kinds]], names=names)

    return candidates


def _prefixes(windows: DataFrame, seen: DataFrame) -> DataFrame:
    """(token, offset, window, size): each window's rarest shingle, of windows all of whose shingles occur somewhere."""
    each = windows.select("window", "size", F.size("tokens").alias("k"), F.posexplode("tokens").alias("offset", "token"))
    ranked = each.join(seen, "token").groupBy("window", "size", "k").agg(F.min(F.struct("n", "offset", "token")).alias("rarest"), F.count(F.lit(1)).alias("occurring"))
    return ranked.where("occurring = k").select("rarest.token", "rarest.offset", "window", "size")


def _merged(found: DataFrame) -> DataFrame:
    """(uid, n_hit, hits): the words inside any match, as a number and as ranges."""
    order = Window.partitionBy("uid").orderBy("begin")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    longest = found.groupBy("uid", "begin").agg(F.max(F.col("begin") + F.col("size")).alias("end"))
    islands = longest.withColumn("fresh", (reach.isNull() | (F.col("begin") > reach)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    ranges = islands.groupBy("uid", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return ranges.groupBy("uid").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """One row per document: the columns of ``carry`` (by default doc_id), n_words, n_hit, hits, items.

    ``hits`` are the ranges (begin, end) of words inside any occurrence of a benchmark window; ``items`` the ids, as sorted
    texts, of the items that have such windows.
    """
    carry = [doc_id] if carry is None else carry
    scratch = Scratch(docs.sparkSession)
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    cut = scratch.write(named.mapInArrow(_windows(window, shingle), "item string, window string, size int, tokens array<bigint>"), "windows")
    of_item = scratch.write(cut.select("window", "item").distinct(), "window-items")
    one_each = cut.groupBy("window").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    windows, seen = scratch.write(one_each, "distinct-windows", n=F.sum(F.size("tokens")), sizes=F.collect_set(F.least("size", F.lit(shingle))))
    sizes = sorted(seen["sizes"])  # of shingles: ``shingle``, and the words of items that have fewer
    every = BitTable(windows.select(F.explode("tokens").alias("token")), seen["n"] or 0)
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_counted(every, sizes), "token bigint, n bigint")
    prefixes, n = scratch.write(_prefixes(windows, counts.groupBy("token").agg(F.sum("n").alias("n"))), "prefixes", n=F.count(F.lit(1)))

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("doc"), F.col(text).alias("text"))
    kind = ", ".join(f"c{i}: {dict(docs.dtypes)[c]}" for i, c in enumerate(carry))
    table = BitTable(prefixes.select("token"), n["n"])
    told = scratch.write(rows.mapInArrow(_candidates(table, sizes, window), f"uid bigint, doc struct<{kind}>, n_words bigint, {_FOUND}"), "candidates")

    met = told.where("token IS NOT NULL").select("uid", "token", "place", "lead", "around").join(prefixes, "token").where("lead >= offset")
    same = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    found = scratch.write(met.where(same).select("uid", (F.col("place") - F.col("offset")).alias("begin"), "size", "window"), "occurrences")
    held = found.select("uid", "window").distinct().join(of_item, "window").select("uid", "item").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    judged = told.where("token IS NULL").select("uid", "doc", "n_words").join(_merged(found), "uid", "left").join(held, "uid", "left")
    return judged.select(
        *[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(carry)],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
