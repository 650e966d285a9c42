"""Approximate nearest neighbours by an inverted multi-index, largest inner product first.

Vectors are split into halves and each half is quantised by its own codebook of CENTROIDS centroids, so a pair of
centroids names one of CENTROIDS ** 2 cells. A query walks through the pairs by rising summed distance, with a heap,
until the cells it has met hold enough entries; these are reranked by their exact inner products in double precision.

The codebooks, and the share of all entries that a query has to meet for the wanted recall, are fitted on a bounded
sample of FIT_ROWS vectors; every vector is indexed. Distance of a half to a centroid is by how much its inner product
falls short of that with the best centroid.

Entries lie in blocks: GROUPS ranges of first centroids, each dealt by digest of ids into blocks of about BLOCK_ROWS, so
that equal or crowded vectors fill several blocks. Queries go to the blocks whose cells they meet, in chunks of about
QUERY_ROWS; a block reads only the inverted lists of the cells that a query meets and returns its best; the best of these
are the result.

Defined results: vectors that are null, zero, of another than the most frequent length (the shortest of several), or
hold a null or non-finite component, and rows with a null id, take no part; of rows with the same id only the smallest
vector does; with fewer candidates than wanted all are returned; no candidates, no rows; other columns pass by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, unit_hash

CENTROIDS = 64
GROUPS = 8
FIT_ROWS = 10_000
FIT_QUERIES = 300
FIT_ROUNDS = 12
WANTED_RECALL = 0.94
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
#: Queries scored at a time within a block.
SCORED = 256


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows (vec_id, vector) that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (usual[0].n if usual else 0))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows


def _codebook(rows: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Plain k-means."""
    centres = rows[rng.permutation(len(rows))[:size]].copy()
    for _ in range(FIT_ROUNDS):
        near = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(rows[:, : self.half], self.first), _nearest(rows[:, self.half :], self.second)

    def walk(self, query: np.ndarray, counts: np.ndarray, enough: float) -> Iterator[tuple[int, int]]:
        """Cells by rising summed distance until they hold ``enough`` entries (own entry included)."""
        one, two = self.first @ query[: self.half], self.second @ query[self.half :]
        by_one, by_two = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
        one, two = np.sort(one.max() - one).tolist(), np.sort(two.max() - two).tolist()
        heap, met, counts = [(0.0, 0, 0)], 0, counts.tolist()
        while heap and met < enough:
            _, a, b = heapq.heappop(heap)
            i, j = by_one[a], by_two[b]
            if counts[i][j]:
                met += counts[i][j]
                yield i, j
            if b + 1 < len(two):
                heapq.heappush(heap, (one[a] + two[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (one[a + 1] + two[0], a + 1, 0))


def fit_multi_index(rows: np.ndarray, wanted: int = 20, recall: float = WANTED_RECALL, seed: int = 11) -> MultiIndex:
    """Codebooks of a sample, and the least share of entries whose walk finds ``recall`` of the true neighbours."""
    rng = np.random.default_rng(seed)
    half = (rows.shape[1] + 1) // 2
    size = min(CENTROIDS, len(rows))
    index = MultiIndex(_codebook(rows[:, :half], size, rng), _codebook(rows[:, half:], size, rng), 1.0)
    queries = rng.permutation(len(rows))[:FIT_QUERIES]
    i, j = index.cells(rows)
    scores = rows[queries] @ rows.T
    scores[np.arange(len(queries)), queries] = -np.inf
    true = np.argsort(-scores, axis=1)[:, : min(wanted, len(rows) - 1)]
    one, two = rows[queries, :half] @ index.first.T, rows[queries, half:] @ index.second.T
    entry = one[:, i] + two[:, j]  # summed inner products fall as summed distances rise
    before = np.array([[(e > e[t]).sum() for t in ts] for e, ts in zip(entry, true)]) / len(rows)
    index.share = float(min(1.0, np.quantile(before, recall) + 1.0 / len(rows))) if before.size else 1.0
    return index


def cell_scores(asked: np.ndarray, masks: np.ndarray, rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Inner products of queries with the entries of the cells they meet (others -inf), and how many were made.

    Entries are sorted by cell; ``masks`` has a bit for each second centroid, by query and first centroid.
    """
    scores, made = np.full((len(asked), len(rows)), -np.inf), 0
    begins = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(rows) else np.zeros(0, int)
    for begin, end in zip(begins, [*begins[1:], len(rows)]):
        met = np.flatnonzero((masks[:, first[begin]] >> np.uint64(second[begin])) & np.uint64(1))
        if len(met):
            scores[met, begin:end] = asked[met] @ rows[begin:end].T
            made += len(met) * (end - begin)
    return scores, made


def _best_of_block(queries: pd.DataFrame, entries: pd.DataFrame, group_size: int, wanted: int) -> pd.DataFrame:
    entries = entries.sort_values(["i", "j", "vec_id"])  # the inverted lists of the block's cells
    ids, rows = entries["vec_id"].to_numpy(), np.frombuffer(b"".join(entries["vector"]), np.float64).reshape(len(entries), -1)
    first, second = entries["i"].to_numpy() % group_size, entries["j"].to_numpy()
    found = []
    for begin in range(0, len(queries), SCORED):
        part = queries.iloc[begin : begin + SCORED]
        asked = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), -1)
        scores, _ = cell_scores(asked, np.array(part["masks"].tolist(), np.int64).view(np.uint64), rows, first, second)
        own = part["query_id"].to_numpy()
        scores[own[:, None] == ids[None]] = -np.inf
        least = np.partition(scores, -wanted, axis=1)[:, -wanted] if len(ids) > wanted else np.full(len(part), -np.inf)
        for k, query in enumerate(own):
            near = np.flatnonzero((scores[k] >= least[k] - 1e-9 * max(1.0, abs(least[k]) if np.isfinite(least[k]) else 1.0)) & (scores[k] > -np.inf))
            exact = (rows[near] * asked[k]).sum(axis=1)
            top = np.lexsort((ids[near], -exact))[:wanted]
            found.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][top], "score": exact[top]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", wanted: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the best entries found for each usable row that fulfils ``is_query``."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    n = rows.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if n < 2:
        return spark.createDataFrame([], empty)
    sample = rows.where(unit_hash(F.lit("index"), F.col("vec_id")) < min(1.0, 1.5 * FIT_ROWS / n)).orderBy(unit_hash(F.lit("index"), F.col("vec_id")), "vec_id").limit(FIT_ROWS).collect()
    index = fit_multi_index(np.array([r.vector for r in sample]), wanted)
    shared = spark.sparkContext.broadcast(index)
    size = len(index.first)
    group_size = -(-CENTROIDS // GROUPS)

    def indexed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.array(part["vector"].tolist(), np.float64)
                i, j = shared.value.cells(x)
                yield pd.DataFrame({"vec_id": part["vec_id"], "i": i.astype(np.int32), "j": j.astype(np.int32), "vector": [r.tobytes() for r in x]})

    entries = materialise(rows.mapInPandas(indexed, "vec_id bigint, i int, j int, vector binary"), "index-entries")
    counts = np.zeros((size, size), np.int64)
    for r in entries.groupBy("i", "j").count().collect():  # at most CENTROIDS ** 2 rows
        counts[r.i, r.j] = r["count"]
    enough = index.share * n
    blocks = [max(1, -(-int(counts[g * group_size : (g + 1) * group_size].sum()) // BLOCK_ROWS)) for g in range(GROUPS)]

    def probes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for query, data in zip(part["vec_id"], part["vector"]):
                masks = [[0] * group_size for _ in range(GROUPS)]
                for i, j in shared.value.walk(np.frombuffer(data, np.float64), counts, enough):
                    masks[i // group_size][i % group_size] |= 1 << j
                for g, mask in enumerate(masks):
                    if any(mask):
                        signed = [m - (1 << 64) if m >> 63 else m for m in mask]
                        found += [(query, g, block, signed, data) for block in range(blocks[g])]
            yield pd.DataFrame(found, columns=["query_id", "group", "block", "masks", "vector"])

    asked = entries.where(is_query(F.col("vec_id")))
    chunks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.repartition(max(8, -(-asked.count() // 512)), "vec_id")
    asked = asked.mapInPandas(probes, "query_id bigint, group int, block int, masks array<bigint>, vector binary")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    group = F.floor(F.col("i") / group_size).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(b) for b in blocks]), group + 1)).cast("int")
    held = entries.select("vec_id", "i", "j", "vector", group.alias("group"), block.alias("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return _best_of_block(one, two, group_size, wanted)

    key = ["group", "block", "chunk"]
    tops = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
