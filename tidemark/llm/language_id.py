"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of WINDOW bytes (the last padded with zeros). A window's bytes are embedded, convolved with
filters of widths 2, 3 and 4, max-pooled over the window and classed by a softmax layer; a text's probabilities are the
mean over its windows, by bytes. All windows of all texts are scored, in batches. For scoring, embedding and filters are
folded into tables by byte and byte pair, so a filter's response is a sum of table rows.

The network learns every language that has a labelled document, from a bounded sample: about FIT_DOCS documents for each
language (an equal share of FIT_TOTAL, if that is less) and WINDOWS_EACH windows of each, chosen by digests of document ids
among those whose crc32(doc_id) mod 4 isn't 2.

Defined results: null text and text without a letter give "und" with score 0; null languages teach nothing; without any
labelled text every prediction is "und"; a null doc_id counts as text "" in the digest; an empty table gives an empty
result; of languages with equal probabilities the first in order is told; repeated rows are told alike, and teach each if they
are drawn; texts of any length are read whole; other columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, short_batches, unit_hash

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
FIT_DOCS, FIT_TOTAL, WINDOWS_EACH = 500, 250_000, 4
EPOCHS, BATCH = 5, 64
HELD_OUT_REMAINDER = 2
#: Windows scored at a time.
SCORED = 1024
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == HELD_OUT_REMAINDER


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, as rows of bytes."""
    data = text.encode("utf-8").lower()
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


class ByteConvNet:
    """Embedding, filters of several widths, max pooling over positions, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        self.classes = classes
        rng = np.random.default_rng(seed)
        p = {"E": rng.normal(0, 0.5, (256, EMBEDDING)), "D": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))), "d": np.zeros(len(classes))}
        for w in WIDTHS:
            p[f"W{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.tables = None

    def _pooled(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        kept, tops = [], []
        embedded = self.p["E"][x]
        for w in WIDTHS:
            places = x.shape[1] - w + 1
            columns = np.concatenate([embedded[:, k : k + places] for k in range(w)], axis=2)
            response = columns @ self.p[f"W{w}"] + self.p[f"b{w}"]
            at = response.argmax(axis=1)
            kept.append((at, columns))
            tops.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        return kept, np.concatenate(tops, axis=1)

    def _softmax(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top, 0) @ self.p["D"] + self.p["d"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept, top = self._pooled(x)
        slope = self._softmax(top)
        slope[np.arange(len(y)), y] -= 1
        slope /= len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["D"], g["d"] = np.maximum(top, 0).T @ slope, slope.sum(axis=0)
        back = (slope @ self.p["D"].T) * (top > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            at, columns = kept[i]
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"W{w}"] = np.einsum("bfk,bf->kf", columns[rows, at], part)
            g[f"b{w}"] = part.sum(axis=0)
            spread = part[:, :, None] * self.p[f"W{w}"].T[None]
            for k in range(w):
                np.add.at(g["E"], x[rows, at + k], spread[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7, rate: float = 0.01) -> ByteConvNet:
        rng, step = np.random.default_rng(seed), 0
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for begin in range(0, len(order), BATCH):
                rows, step = order[begin : begin + BATCH], step + 1
                for k, g in self.gradients(x[rows], y[rows]).items():  # Adam
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.tables = None
        return self

    def fold(self) -> None:
        """Responses by byte pair: two-byte parts of each filter, and the odd byte of the middle width."""
        e, self.tables = self.p["E"], {}
        for w in WIDTHS:
            parts = [e @ self.p[f"W{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            pairs = [(parts[k][:, None] + parts[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            self.tables[w] = (pairs, parts[-1] if w % 2 else None)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.fold()
        found = np.empty((len(x), len(self.classes)), np.float64)
        for begin in range(0, len(x), SCORED):
            bytes_at = np.ascontiguousarray(x[begin : begin + SCORED].T).astype(np.intp)
            pair_at = bytes_at[:-1] * 256 + bytes_at[1:]
            tops = []
            for w in WIDTHS:
                pairs, odd = self.tables[w]
                best = np.full((bytes_at.shape[1], FILTERS), -np.inf, np.float32)
                for at in range(WINDOW - w + 1):
                    response = pairs[0].take(pair_at[at], axis=0)
                    for k in range(1, len(pairs)):
                        response += pairs[k].take(pair_at[at + 2 * k], axis=0)
                    if odd is not None:
                        response += odd.take(bytes_at[at + w - 1], axis=0)
                    np.maximum(best, response, out=best)
                tops.append(best + self.p[f"b{w}"])
            found[begin : begin + SCORED] = self._softmax(np.concatenate(tops, axis=1))
        return found

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.classes else []
        at = 0
        while at < len(which):
            group, rows = [], []
            while at < len(which) and len(rows) < 64 and sum(map(len, rows)) < 8 * SCORED:
                group.append(which[at])
                rows.append(windows_of(texts[which[at]]))
                at += 1
            shares, sums, every = [], np.zeros((len(rows), len(self.classes))), np.concatenate(rows)
            for i, r in zip(group, rows):
                shares.append(np.full(len(r), WINDOW, np.float64))
                shares[-1][-1] = max(1, len(texts[i].encode("utf-8")) - (len(r) - 1) * WINDOW)
            share, owner = np.concatenate(shares), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            for begin in range(0, len(every), 8 * SCORED):  # a long text's probabilities aren't held at once
                part = slice(begin, begin + 8 * SCORED)
                np.add.at(sums, owner[part], share[part, None] * self.probabilities(every[part]))
            for k, i in enumerate(group):
                mean = sums[k] / shares[k].sum()
                languages[i], scores[i] = self.classes[int(mean.argmax())], float(min(1.0, mean.max()))
        return languages, scores


def fit_language_id(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ByteConvNet:
    """Train on a bounded sample of the rows that aren't held out."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    labelled = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Written, so that Spark knows the table's size when it plans the join below and shuffles no texts for a few languages.
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    languages = counts.count()
    if not languages:
        return ByteConvNet([])
    each = min(FIT_DOCS, FIT_TOTAL / languages)
    # Values of lang may be many, so their rates are joined, never gathered.
    rates = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("rate"))
    drawn = labelled.join(rates, "lang").where(unit_hash(F.lit("language"), F.col("doc_id")) < F.col("rate"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for language, one in zip(part["lang"], part["text"]):
                if _LETTER.search(one):
                    rows = windows_of(one)
                    step = zlib.crc32(rows.tobytes())
                    found += [(language, rows[k].tobytes()) for k in sorted({(step + k * 7919) % len(rows) for k in range(WINDOWS_EACH)})]
            yield pd.DataFrame(found, columns=["lang", "window"])

    sample = drawn.select("lang", "text").mapInPandas(cut, "lang string, window binary").toPandas()
    sample = sample.sort_values(["lang", "window"])
    classes = sorted(set(sample["lang"]))
    if not classes:
        return ByteConvNet([])
    x = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet(classes).train(x, np.searchsorted(classes, sample["lang"]))


def identify_language(docs: DataFrame, model: ByteConvNet, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns of ``carry`` (by default doc_id), held_out, lang_pred, score."""
    carry = [doc_id] if carry is None else carry
    short_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            languages, scores = model.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": languages, "score": scores})

    rows = docs.select(*carry, held_out(F.col(doc_id)).alias("held_out"), predicted(F.col(text)).alias("p"))
    return rows.select(*carry, "held_out", "p.lang_pred", "p.score")
