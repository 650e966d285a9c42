"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration, trained in numpy.

Features of a whole text: densities of a lexicon of words and word stems, its strength, how close hits stand to a
second-person pronoun, rates of capitals, punctuation, exclamation, digits and obfuscated words, and lengths.

All is learned from a bounded sample of the labelled rows whose crc32(doc_id) mod 4 isn't 2, about FIT_POSITIVE with the
label and FIT_NEGATIVE without, chosen by digests of document ids. The lexicon is a short list of common insults and the
terms that many texts with the label and few without have, in at least LEXICON_LEAST different surroundings, so that
copies of one text don't make one. Each half of the sample is described by the lexicon that the other half gives; three
quarters of these rows make the trees and one, weighted back to all rows, the calibration. Texts are then scored with
the lexicon of the whole sample.

Defined results: null text counts as empty; every text gets a score, empty ones too; rows without a label teach nothing;
conflicting labels count as 1; a document that is repeated teaches as often as it stands there; repeated rows and ties get
equal scores; texts of any length are read whole; without labels all scores are 0; a null doc_id counts as text "" in the digest; an empty
table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, unit_hash
from tidemark.llm.language_id import held_out

FIT_POSITIVE, FIT_NEGATIVE = 4000, 8000
LEXICON_LEAST, LEXICON_ODDS = 4, 8.0
STEM_LENGTHS = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Characters on either side of a hit in which a second-person pronoun counts as near.
NEAR = 40

_WORD = re.compile(r"[^\W_]+")
# Common insults, with the log-odds that they start from.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "imbecile", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "bastard", "jerk", "creep", "idiota", "imbécil", "estúpido", "basura", "dummkopf", "arschloch", "abschaum", "trottel", "crétin", "connard", "salaud", "abruti")
INSULT_ODDS = 3.0
# Second-person pronouns of the common languages.
_SECOND_PERSON = re.compile(r"\b(?:you|your|yours|yourself|du|dich|dir|dein|deine|ihr|euch|tu|te|toi|ton|ta|vous|votre|tú|ti|tus|usted|ustedes|vosotros)\b")
_OBFUSCATED = re.compile(r"[A-Za-z][0-9@$*!|]+[A-Za-z]|\b(?:[A-Za-z][.\-*_]){2,}[A-Za-z]\b")
_SYMBOL_RUN = re.compile(r"[#$%&*@!?]{2,}")
FEATURES = 14


class Lexicon:
    """Terms with their log-odds; a stem matches words that begin with it, a word only itself."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.machine = words, stems, None

    def hits(self, lowered: str) -> list[tuple[int, float, bool]]:
        """(position, log-odds, whole word) of each hit; a word counts once, as itself if it can."""
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for term in {**self.stems, **self.words}:
                self.machine.add_word(term, term)
            self.machine.make_automaton()
        if not len(self.machine):
            return []
        best: dict[int, tuple[float, bool]] = {}
        for end, term in self.machine.iter(lowered):
            begin = end - len(term) + 1
            if begin and (lowered[begin - 1].isalnum()):
                continue
            whole = end + 1 == len(lowered) or not lowered[end + 1].isalnum()
            odds = [(self.words[term], True)] if whole and term in self.words else []
            odds += [(self.stems[term], False)] if not whole and term in self.stems else []
            for one in odds:
                best[begin] = max(best.get(begin, (-1e9, False)), one)
        return [(at, odds, whole) for at, (odds, whole) in sorted(best.items())]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    lowered = text.lower()
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    letters = by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[128:].sum() / 2
    capitals, digits, spaces = by_byte[65:91].sum(), by_byte[48:58].sum(), by_byte[[9, 10, 11, 12, 13, 32]].sum()
    marks = by_byte[33:127].sum() - by_byte[65:91].sum() - by_byte[97:123].sum() - digits
    n, words = max(1, len(text)), spaces + 1
    hits = lexicon.hits(lowered)
    near = sum(1 for at, _, _ in hits if _SECOND_PERSON.search(lowered, max(0, at - NEAR), at + NEAR))
    whole = sum(1 for _, _, w in hits if w)
    strengths = sorted((odds for _, odds, _ in hits), reverse=True)
    return [
        np.log1p(whole), np.log1p(len(hits) - whole), whole / words, (len(hits) - whole) / words,
        strengths[0] if strengths else -10.0, sum(strengths[:3]), near / words, near / max(1, len(hits)),
        capitals / max(1.0, letters), marks / n, (by_byte[33] + by_byte[63]) / n,
        (len(_OBFUSCATED.findall(text)) + len(_SYMBOL_RUN.findall(text))) / words, digits / n, np.log1p(n),
    ]


class BoostedTrees:
    """Logistic gradient boosting with histogram trees of a fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            margin += self._apply(tree, binned)
        return self

    @staticmethod
    def _grow(binned, slope, bend):
        feature, cut, leaf = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS), np.zeros(2**DEPTH)
        node = np.zeros(len(slope), int)
        for level in range(DEPTH):
            for k in range(2**level):
                rows = node == k
                g, h = slope[rows], bend[rows]
                if len(g) < 20:
                    continue
                best = 1e-6
                for f in range(binned.shape[1]):
                    b = binned[rows, f]
                    gs, hs = np.cumsum(np.bincount(b, g, BINS))[:-1], np.cumsum(np.bincount(b, h, BINS))[:-1]
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    if gain.max() > best:
                        best, feature[2**level - 1 + k], cut[2**level - 1 + k] = gain.max(), f, gain.argmax()
            at = 2**level - 1 + node
            node = 2 * node + (binned[np.arange(len(node)), feature[at]] > cut[at])
        for k in range(2**DEPTH):
            leaf[k] = -RATE * slope[node == k].sum() / (bend[node == k].sum() + 1)
        return feature, cut, leaf

    @staticmethod
    def _apply(tree, binned):
        feature, cut, leaf = tree
        node = np.zeros(len(binned), int)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (binned[np.arange(len(node)), feature[at]] > cut[at])
        return leaf[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)
        return self.base + sum(self._apply(t, binned) for t in self.trees)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, rate) of the closest rising step function."""
    blocks: list[list[float]] = []  # sum of weight * y, weight, lowest and highest margin
    for i in np.argsort(margin, kind="stable"):
        blocks.append([weight[i] * y[i], weight[i], margin[i], margin[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    return np.array([m for b in blocks for m in (b[2], b[3])]), np.array([r for b in blocks for r in (b[0] / b[1],) * 2])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, knots: tuple | None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, texts: list) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts], np.float64)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


def _learn_lexicon(sample: DataFrame) -> Lexicon:
    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            with_label, without = Counter(), Counter()
            for text, label in zip(part["text"], part["label"]):
                (with_label if label else without).update(_terms(text))
            terms = list({*with_label, *without})
            yield pd.DataFrame({"term": terms, "p": [with_label[t] for t in terms], "n": [without[t] for t in terms]}).astype({"p": "int64", "n": "int64"})

    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    counts = sample.mapInPandas(counted, "term string, p bigint, n bigint").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (positive + 1)) - F.log((F.col("n") + 0.5) / (negative + 1))
    likely = counts.withColumn("odds", odds).where((F.col("p") >= LEXICON_LEAST) & (F.col("odds") > float(np.log(LEXICON_ODDS))))
    chosen = {r.term: r.odds for r in likely.collect()}  # terms of a bounded sample

    def surrounded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = set()
            for text, label in zip(part["text"], part["label"]):
                words = _WORD.findall(text.lower()) if label else []
                for i, w in enumerate(words):
                    for term in (w, *(w[:n] + "*" for n in STEM_LENGTHS if len(w) > n)):
                        if term in chosen:
                            found.add((term, zlib.crc32("|".join([*words[max(0, i - 2) : i], "", *words[i + 1 : i + 3]]).encode())))
            yield pd.DataFrame(list(found), columns=["term", "around"]).astype({"around": "int64"})

    around = sample.mapInPandas(surrounded, "term string, around bigint").groupBy("term").agg(F.countDistinct("around").alias("n")).where(F.col("n") >= LEXICON_LEAST)
    kept = {r.term for r in around.collect()}
    words = {t: o for t, o in chosen.items() if t in kept and not t.endswith("*")}
    words = dict.fromkeys(INSULTS, INSULT_ODDS) | words
    return Lexicon(words, {t[:-1]: o for t, o in chosen.items() if t in kept and t.endswith("*")})


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """Learn lexicon, trees and calibration from a bounded sample of the labelled rows that aren't held out."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    totals = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(totals) < 2:
        return ToxicityModel(Lexicon({}, {}), None, None)
    rates = {k: min(1.0, most / totals[k]) for k, most in ((1, FIT_POSITIVE), (0, FIT_NEGATIVE))}
    drawn = unit_hash(F.lit("toxic"), F.col("_id")) < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    marks = marks.where(drawn)  # about FIT_POSITIVE + FIT_NEGATIVE rows
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(marks), "_id").select("_id", "text", "label")
    sample = materialise(sample.withColumn("fold", F.floor(unit_hash(F.lit("fold"), F.col("_id")) * 8)), "toxic-sample")
    halves = [_learn_lexicon(sample.where(part).select("text", "label")) for part in ("fold >= 4", "fold < 4")]
    lexicon = _learn_lexicon(sample.select("text", "label"))

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["_id"], "label": part["label"], "fold": part["fold"], "x": [features(t, halves[int(f >= 4)]) for t, f in zip(part["text"], part["fold"])]})

    kind = f"id {dict(marks.dtypes)['_id']}, label int, fold bigint, x array<double>"
    rows = sample.mapInPandas(featured, kind).toPandas().sort_values("id", kind="stable")
    if rows["label"].nunique() < 2:
        return ToxicityModel(lexicon, None, None)
    x, y, last = np.array(rows["x"].tolist()), rows["label"].to_numpy(), (rows["fold"] % 4 == 3).to_numpy()
    if y[~last].min(initial=1) == y[~last].max(initial=0) or y[last].min(initial=1) == y[last].max(initial=0):
        trees, last = BoostedTrees().fit(x, y), np.ones(len(y), bool)
    else:
        trees = BoostedTrees().fit(x[~last], y[~last])
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    return ToxicityModel(lexicon, trees, isotonic(trees.margin(x[last]), y[last], weight[last]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), scored(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
