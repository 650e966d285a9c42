"""Links between sets whose Jaccard similarity is 0.75 or more, from MinHash signatures, without listing a bucket's pairs.

Nodes are linked within the buckets of their bands (see candidates). A candidate pair whose signatures agree in less than
``least`` slots (less than ``least_small`` if a set has too few elements for its slots to be independent) isn't verified; all
others are confirmed on the
full sets, by hashes first and then on the elements themselves. What large buckets leave unmerged is compared in
blocks of bounded size, each pair in the first bucket that it shares; a block gives a spanning forest of its links, no
more. So large groups of copies, or of texts with a passage in common, make no square of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.candidates import link_buckets, with_hubs
from tidemark.llm.common import Scratch

NUMERATOR, DENOMINATOR = 75, 100
#: Elements of a home of a large bucket (two homes make a block), and for how many a row's signature and bands count.
BLOCK_ELEMENTS, ROW_ELEMENTS = 1 << 20, 256
#: Rows that are compared with a home at a time.
SLICE = 16
#: Text characters whose sets are made at a time.
GROUP_CHARS = 1 << 20

Sets = Callable[[list], tuple[np.ndarray, np.ndarray]]
Elements = Callable[[str], set]


def groups(*columns: list) -> Iterator[tuple[int, int]]:
    """Ranges of the rows of ``columns`` (texts) of about GROUP_CHARS characters."""
    begin, size = 0, 0
    for i, row in enumerate(zip(*columns)):
        size += sum(len(t or "") for t in row)
        if size >= GROUP_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(columns[0]):
        yield begin, len(columns[0])


def similar(both: int, one: int, two: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (one + two - both)


@dataclass(frozen=True)
class Agreement:
    """In how many of ``slots`` two signatures must agree: ``least``, or ``least_small`` if a set has less than ``tells_from`` elements."""

    slots: int
    least: int
    least_small: int = 0
    tells_from: int = 0


#: Bytes of a signature in a number of 64 bits; the eighth stays free, so no sum overflows.
_BYTES, _LOW, _HIGH = 7, int("7F" * 7, 16), int("80" * 7, 16)


def words(signature: Column, slots: int) -> Column:
    """A signature of ``slots`` bytes as an array of numbers."""
    parts = [F.substring(signature, at + 1, _BYTES) for at in range(0, slots, _BYTES)]
    return F.array(*[F.conv(F.hex(p), 16, 10).cast("long") for p in parts])


def agreeing(one: str, two: str, slots: int) -> Column:
    """In how many bytes two arrays of ``words`` agree: those where no bit differs."""
    differ = [F.col(one)[i].bitwiseXOR(F.col(two)[i]) for i in range(-(-slots // _BYTES))]
    marked = [(x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH)) for x in differ]
    return F.lit(slots) - reduce(Column.__add__, [F.bit_count(x) for x in marked])


def confirmed(one: str, two: str, elements: Elements) -> bool:
    """Whether the sets of two texts are similar, by their elements."""
    a, b = elements(one), elements(two)
    return similar(len(a & b), len(a), len(b))


def hashed_similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets of hashes are similar; if their sizes rule that out they aren't compared."""
    fewer, more = sorted((len(one), len(two)))
    return similar(fewer, fewer, more) and similar(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two))


def _links(ones: list, twos: list, sets_of: Sets, elements: Elements) -> list[bool]:
    """Whether the full sets of the texts of each pair are similar. The set of a text that many pairs name is made once."""
    verdicts = []
    for begin, end in groups(ones, twos):
        place: dict[str, int] = {}
        pairs = [(place.setdefault(x, len(place)), place.setdefault(y, len(place))) for x, y in zip(ones[begin:end], twos[begin:end])]
        hashes, offsets = sets_of(list(place))
        sets = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        hashed = [hashed_similar(sets[i], sets[k]) for i, k in pairs]
        verdicts += [h and confirmed(x, y, elements) for h, x, y in zip(hashed, ones[begin:end], twos[begin:end])]
    return verdicts


class _Block:
    """The rows of a large bucket's homes ``low`` and ``high``, or of one home, whose links join components."""

    def __init__(self, rows: pd.DataFrame, sets_of: Sets, elements: Elements, agree: Agreement):
        self.agree, self.elements = agree, elements
        self.nodes, self.component, home = (rows[c].to_numpy() for c in ("node", "component", "home"))
        self.ones, self.twos = np.flatnonzero(home == rows["low"].iloc[0]), np.flatnonzero(home == rows["high"].iloc[0])
        signs = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), -1)
        self.signs = np.pad(signs, [(0, 0), (0, -signs.shape[1] % 8)]).view(np.uint64)
        bands = np.array(rows["bands"].tolist(), np.int64)
        self.earlier = bands[:, : np.flatnonzero(bands[0] == rows["bucket"].iloc[0])[0]]
        self.texts, sets, sizes = rows["text"].tolist(), [], []
        for begin, end in groups(self.texts):
            hashes, offsets = sets_of(self.texts[begin:end])
            sets.append(hashes)
            sizes.append(np.diff(offsets))
        self.sizes = np.concatenate(sizes)
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.places = np.split(flat, np.cumsum(self.sizes)[:-1])  # a set as places in ``inside``
        self.inside, self.parent = np.zeros(len(known), bool), {}

    def differing(self, ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
        """In how many slots (bytes) the signatures of each pair differ, eight slots at a time."""
        low, count = np.uint64(int("7F" * 8, 16)), np.zeros((len(ones), len(twos)), np.int16)
        for column in self.signs.T:
            bits = column[ones, None] ^ column[None, twos]
            count += np.bitwise_count((((bits & low) + low) | bits) & ~low)  # a byte's high bit says that it isn't zero
        return count

    def likely(self, ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
        """Of each pair, whether it could be a link between components and doesn't meet in an earlier band's bucket."""
        one, two = self.sizes[ones, None], self.sizes[None, twos]
        least = np.where(np.minimum(one, two) < self.agree.tells_from, self.agree.least_small, self.agree.least)
        found = self.differing(ones, twos) <= self.agree.slots - least
        found &= (np.minimum(one, two) * DENOMINATOR >= np.maximum(one, two) * NUMERATOR) & (self.component[ones, None] != self.component[None, twos])
        x, y = np.nonzero(found)
        found[x, y] = ~(self.earlier[ones[x]] == self.earlier[twos[y]]).any(axis=1)
        return found

    def root(self, row: int) -> int:
        c = self.component[row]
        while self.parent.get(c, c) != c:
            self.parent[c] = self.parent.get(self.parent[c], self.parent[c])
            c = self.parent[c]
        return c

    def links_of(self, row: int, others: np.ndarray) -> Iterator[int]:
        """The rows of ``others`` that are linked with ``row`` and not yet in its component."""
        others = [k for k in others if self.root(k) != self.root(row)]
        self.inside[self.places[row]] = True
        for k in others:
            both = np.count_nonzero(self.inside[self.places[k]])
            if similar(both, self.sizes[row], self.sizes[k]) and self.root(k) != self.root(row) and confirmed(self.texts[row], self.texts[k], self.elements):
                self.parent[self.root(row)] = self.root(k)
                yield k
        self.inside[self.places[row]] = False

    def forest(self) -> list[tuple[int, int]]:
        found, usual = [], pd.Series(self.component).mode().iloc[0]
        for ones, twos in ((self.ones, self.twos), (self.twos, self.ones)):
            ones = ones[self.component[ones] != usual]  # so is at least one end of each pair
            for at in range(0, len(ones), SLICE):
                part = ones[at : at + SLICE]
                found += [(self.nodes[i], self.nodes[k]) for i, row in zip(part, self.likely(part, twos)) for k in self.links_of(i, twos[row])]
        return found


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of buckets (with ``homes``) dealt to their homes, and repeated for each pair of homes."""
    dealt = rows.withColumn("home", F.pmod(F.xxhash64("node", F.lit(7)), F.col("homes")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
    return other.select("*", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"))


class SetLinks:
    """Components of nodes by links between their sets.

    ``signed`` has node, weight (about the set's size), bands (an array of bucket numbers) and signature (a byte a slot);
    ``texts`` has node and text; ``sets_of`` makes the sets of a list of texts: sorted distinct hashes, and offsets;
    ``elements`` makes the set of one text itself.
    """

    def __init__(self, scratch: Scratch, signed: DataFrame, texts: DataFrame, sets_of: Sets, elements: Elements, agree: Agreement):
        self.scratch, self.signed, self.texts, self.sets_of, self.elements, self.agree = scratch, signed, texts, sets_of, elements, agree

    def components(self) -> DataFrame:
        """Rows (node, component) of the nodes that have links."""
        members = with_hubs(self.signed.select("node", "weight", F.explode("bands").alias("bucket")), self.scratch)
        # Most nodes meet no other. Nodes grow with the corpus, so they are never broadcast: texts are shuffled at every size, and looked up in a hash table of a partition's nodes.
        nodes = self.scratch.write(members.select("node").distinct(), "met").hint("shuffle_hash")
        signed = self.signed.join(nodes, "node", "left_semi").withColumn("words", words(F.col("signature"), self.agree.slots))
        signed = self.scratch.write(signed, "met-signed")
        self.scratch.drop(self.signed)
        self.signed, self.texts = signed, self.scratch.write(self.texts.join(nodes, "node", "left_semi"), "met-texts")
        return link_buckets(members, self.compare, self.link_large, self.scratch)

    @staticmethod
    def _with(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Facts of both ends beside the pairs. Hubs are hot keys: both sides are written, so adaptive execution splits them."""
        for end in ("a", "b"):
            pairs = pairs.join(facts.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in facts.columns if c != "node"]), end)
        return pairs

    def compare(self, pairs: DataFrame, one_each: bool = False) -> DataFrame:
        """Links among pairs (a, b); with ``one_each`` only the likeliest pair of each a is tested."""
        sets_of, elements = self.sets_of, self.elements

        @F.pandas_udf(T.BooleanType())
        def linked(one: pd.Series, two: pd.Series) -> pd.Series:
            return pd.Series(_links(one.tolist(), two.tolist(), sets_of, elements), dtype=bool)

        both = self._with(self.scratch.write(pairs, "pairs"), self.signed.select("node", "words", "weight"))
        least = F.when(F.least("weight_a", "weight_b") < self.agree.tells_from, self.agree.least_small).otherwise(self.agree.least)
        likely = both.select("a", "b", least.alias("least"), agreeing("words_a", "words_b", self.agree.slots).alias("agreeing")).where("agreeing >= least")
        if one_each:
            likely = likely.groupBy("a").agg(F.max_by("b", F.struct("agreeing", "b")).alias("b"))
        likely = self.scratch.write(likely.select("a", "b"), "likely")
        # Texts are several times smaller than the hashes of their shingles, so sets are made where pairs meet.
        links = self.scratch.write(self._with(likely, self.texts).where(linked("text_a", "text_b")).select("a", "b"), "links")
        self.scratch.drop(likely)
        return links

    def link_large(self, large: DataFrame) -> DataFrame:
        """Links that join the components of large mixed buckets."""
        sets_of, elements, agree = self.sets_of, self.elements, self.agree

        def forest(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_Block(rows, sets_of, elements, agree).forest(), columns=["a", "b"]).astype("int64")

        homes = large.join(self.signed.select("node", "weight"), "node").groupBy("bucket").agg(F.sum(F.col("weight") + ROW_ELEMENTS).alias("load"))
        homes = self.scratch.write(homes.select("bucket", F.ceil(F.col("load") / BLOCK_ELEMENTS).cast("int").alias("homes")), "homes")
        full = large.select("bucket", "node", "component").join(homes, "bucket").join(self.signed.select("node", "bands", "signature"), "node").join(self.texts, "node")
        links = _blocks(full).groupBy("bucket", "low", "high").applyInPandas(forest, "a bigint, b bigint").distinct()
        links = self.scratch.write(links, "large-links")
        self.scratch.drop(homes)
        return links
