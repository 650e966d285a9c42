"""Packing documents into training sequences by minimum bin slack.

A document's tokens fill as many whole windows as they can; what remains (shorter than a window) is an item. For the
items, windows are filled one pattern at a time: the largest item left is set, and a bitset subset-sum dynamic program
over the lengths left, each as often as it is left, finds the multiset closest to the capacity; the counts are read
back from the stored bitsets. A pattern is used as often as the counts allow, so planning depends on the number of
lengths (under 2048), not on the number of documents, and the driver only holds one count for each length. If no
multiset fills the window, the slack is filled by cutting one more item, whose rest goes back among the items. So only
the last sequence has padding.

Documents get their places in the plan by their rank among the items of their length. Ranks are made of counts a shard
and length plus row numbers inside a shard, so a length that a third of all documents share is no single task's work.

Token ids: those of the vocabulary file by the tokenizers library, plus one end id. Texts of Latin characters go
through tiktoken with the same vocabulary, several times faster with the same ids; all others go through tokenizers.

Defined results: null text is empty (one end id); a null doc_id stays null; repeated rows are packed each; an empty
table gives an empty result; long texts are cut into whole windows, and runs of white space of any length are tokenised;
other columns pass by, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

CAPACITY = 2048
END_ID = 1
#: Rows of a shard, within which items are numbered.
SHARD_ROWS = 20_000
_OUTSIDE_LATIN = re.compile("[^\\x00-\\u024f]")
#: The fast encoder's splitting recurses over a run of white space; longer runs go to the library.
_LONG_BLANK = re.compile(r"\s{5000}")


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable character stands for in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file (tokenizers .json), special strings handled as its default."""

    def __init__(self, path: str):
        self.path, self._fast, self._slow = path, None, None

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    @property
    def fast(self):
        if self._fast is None:
            import tiktoken

            with open(self.path, encoding="utf-8") as file:
                spec = json.load(file)
            byte_of = byte_of_symbol()
            specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in specials.values()}
            # Fixed value: the splitting pattern of byte-level vocabularies.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self._fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        return self._fast

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _OUTSIDE_LATIN.search(text) or _LONG_BLANK.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, used by all of its tasks."""
    return Encoder(path)


# --- the plan ----------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """What becomes of the items of each length, by their rank: parallel arrays, sorted by length and first rank.

    Items ``first`` <= rank < ``first + repeats * times`` of ``length`` are used by one pattern: the rank's offset
    modulo ``repeats`` says in which of its sequences, and its quotient which of the ``times`` places ``step`` apart.
    Where ``used`` is less than ``length`` the rest is an item of length - used, with ranks from ``rest_first`` on.
    """

    length: list = field(default_factory=list)
    first: list = field(default_factory=list)
    repeats: list = field(default_factory=list)
    times: list = field(default_factory=list)
    sequence: list = field(default_factory=list)
    offset: list = field(default_factory=list)
    used: list = field(default_factory=list)
    rest_first: list = field(default_factory=list)
    sequences: int = 0
    cuts: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("length", "first", "repeats", "times", "sequence", "offset", "used", "rest_first")
        order = np.lexsort((self.first, self.length))
        return {n: np.array(getattr(self, n), np.int64)[order] for n in names}


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    layers, reach = [], 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        before, left, size = reach, min(counts[length], room // length), 1
        while left > 0:  # powers of two copies at a time
            size = min(size, left)
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        layers.append((length, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        times = 0
        while not before >> total & 1:
            total -= length
            times += 1
        if times:
            chosen[length] = times
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Plan:
    """Plan sequences of ``capacity`` for items of the given lengths (below it) and counts."""
    left = {k: v for k, v in counts.items() if v > 0}
    taken: dict[int, int] = dict.fromkeys(left, 0)  # ranks used of each length
    made = dict(left)  # ranks handed out of each length
    plan = Plan()

    def use(length, times, repeats, offset, used=None, rest_first=0):
        for name, value in zip(("length", "first", "repeats", "times", "sequence", "offset", "used", "rest_first"), (length, taken[length], repeats, times, plan.sequences, offset, used or length, rest_first)):
            getattr(plan, name).append(value)
        taken[length] += times * repeats
        left[length] -= times * repeats
        if not left[length]:
            del left[length]

    while left:
        largest = max(left)
        rest = {**left, largest: left[largest] - 1}
        chosen = closest_multiset(rest, capacity - largest)
        chosen[largest] = chosen.get(largest, 0) + 1
        slack = capacity - sum(k * v for k, v in chosen.items())
        donors = [k for k in left if k > slack and left[k] > chosen.get(k, 0)] if slack else []
        donor = max(donors, key=lambda k: (left[k] - chosen.get(k, 0), k)) if donors else None
        need = dict(chosen)
        if donor:
            need[donor] = need.get(donor, 0) + 1
        repeats = min(left[k] // v for k, v in need.items())
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            use(length, times, repeats, offset)
            offset += length * times
        if donor:
            rest_length = donor - slack
            use(donor, 1, repeats, offset, slack, made.get(rest_length, 0))
            made[rest_length] = made.get(rest_length, 0) + repeats
            taken.setdefault(rest_length, 0)
            left[rest_length] = left.get(rest_length, 0) + repeats
            plan.cuts += repeats
        plan.sequences += repeats
    return plan


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    """The pieces of items: item (its position), start within the item, length, sequence, offset."""
    key = plan["length"] * (1 << 40) + plan["first"]
    item, start, found = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(item):
        row = np.searchsorted(key, length * (1 << 40) + rank, "right") - 1
        inside, repeats, used = rank - plan["first"][row], plan["repeats"][row], plan["used"][row]
        sequence = plan["sequence"][row] + inside % repeats
        offset = plan["offset"][row] + inside // repeats * plan["length"][row]
        found.append(pd.DataFrame({"item": item, "start": start, "length": used, "sequence": sequence, "offset": offset}))
        more = used < length
        item, start, length, rank = item[more], (start + used)[more], (length - used)[more], (plan["rest_first"][row] + inside % repeats)[more]
    return pd.concat(found) if found else pd.DataFrame({k: np.zeros(0, np.int64) for k in ("item", "start", "length", "sequence", "offset")})


# --- the job -----------------------------------------------------------------------------------------------------


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path).ids
        for batch in batches:
            tokens, windows, item, item_crc, item_ids = [], [], [], [], []
            for one in batch.column("text"):  # one text at a time
                ids = np.append(ids_of(one.as_py()), np.uint32(end_id)).astype(np.uint32)
                whole = len(ids) // capacity
                tokens.append(len(ids))
                windows.append([_crc(ids[k * capacity : (k + 1) * capacity]) for k in range(whole)])
                item.append(len(ids) - whole * capacity)
                item_crc.append(_crc(ids[whole * capacity :]))
                item_ids.append(ids[whole * capacity :].tobytes())
            columns = [batch.column("uid"), batch.column("doc_id"), *[pa.array(v, t) for v, t in ((tokens, pa.int64()), (windows, pa.list_(pa.int64())), (item, pa.int64()), (item_crc, pa.int64()), (item_ids, pa.binary()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "doc_tokens", "windows", "item", "item_crc", "item_ids"])

    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = f"uid bigint, doc_id {dict(docs.dtypes)[doc_id]}, doc_tokens bigint, windows array<bigint>, item bigint, item_crc bigint, item_ids binary"
    table = materialise(base.mapInArrow(tokenised, kind), "pack-tokens")

    n_rows, = table.agg(F.count(F.lit(1))).first()
    shards = max(1, -(-n_rows // SHARD_ROWS))
    slim = table.select("uid", "doc_id", "doc_tokens", "windows", "item", "item_crc", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))

    counts = materialise(slim.groupBy("shard", "item").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r.item: r.n for r in counts.where("item > 0").groupBy("item").agg(F.sum("n").alias("n")).collect()}  # under `capacity` rows
    plan = minimum_bin_slack(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan.arrays())

    # Rank among the items of a length = those of earlier shards + the row number inside the shard.
    earlier = Window.partitionBy("item").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "item", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    whole = slim.groupBy("shard").agg(F.sum(F.size("windows")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard of SHARD_ROWS rows
    whole = whole.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("whole_before"))
    by_shard = Window.partitionBy("shard").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = slim.withColumn("whole_inside", F.sum(F.size("windows")).over(by_shard) - F.size("windows"))
    ranked = ranked.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "item").orderBy("uid")) - 1)
    ranked = ranked.join(starts, ["shard", "item"]).join(whole, "shard")
    ranked = ranked.select("uid", "doc_id", "doc_tokens", "windows", "item", "item_crc", (F.col("earlier") + F.col("inside")).alias("rank"), (F.col("whole_before") + F.col("whole_inside") + F.lit(plan.sequences)).alias("first_whole"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_whole = b["windows"].map(len).to_numpy()
            row = np.repeat(np.arange(len(b)), n_whole)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n_whole) - n_whole, n_whole)
            full = pd.DataFrame({"row": row, "start": nth * capacity, "length": capacity, "ids_crc32": [int(x) for w in b["windows"] for x in w], "sequence_id": b["first_whole"].to_numpy()[row] + nth, "offset": 0, "cut": False})
            has = np.flatnonzero(b["item"].to_numpy() > 0)
            p = place(shared.value, b["item"].to_numpy()[has], b["rank"].to_numpy()[has])
            row = has[p["item"].to_numpy()]
            item = b["item"].to_numpy()[row]
            rest = pd.DataFrame({"row": row, "start": p["start"].to_numpy() + n_whole[row] * capacity, "length": p["length"].to_numpy(), "ids_crc32": b["item_crc"].to_numpy()[row], "sequence_id": p["sequence"].to_numpy(), "offset": p["offset"].to_numpy(), "cut": p["length"].to_numpy() < item})
            both = pd.concat([full, rest]).astype({"ids_crc32": "int64"})
            out = b[["uid", "doc_id", "doc_tokens"]].iloc[both["row"].to_numpy()].reset_index(drop=True)
            yield pd.concat([out, both.drop(columns="row").reset_index(drop=True)], axis=1)

    kind = f"uid bigint, doc_id {dict(docs.dtypes)[doc_id]}, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, cut boolean"
    pieces = ranked.mapInPandas(placed, kind)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not plan.cuts:
        return pieces.select(*columns)

    # Digests of the pieces of cut items come from the stored ids.
    pieces = materialise(pieces, "pack-pieces")
    cut = pieces.where("cut")
    ids = table.select("uid", "item_ids", "item")
    joined = ids.join(cut, "uid")

    @F.pandas_udf("bigint")
    def piece_crc(ids: pd.Series, begin: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([_crc(np.frombuffer(i, "<u4")[b : b + n]) for i, b, n in zip(ids, begin, length)], dtype="int64")

    begin = F.col("start") - (F.col("doc_tokens") - F.col("item"))
    fixed = joined.withColumn("ids_crc32", piece_crc("item_ids", begin, "length"))
    return pieces.where("NOT cut").select(*columns).unionByName(fixed.select(*columns))
