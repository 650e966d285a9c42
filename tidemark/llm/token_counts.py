"""Exact token counts of every prefix of a text, by dynamic programming over a BPE vocabulary.

The encoding of a prefix ends in exactly one token t, and what stands before t is the encoding of a shorter prefix
whose own last token u may stand before t (BPE turns the symbols of u and t into just these two tokens). So
count[k] = count[k - len(t)] + 1, where t is found among the vocabulary entries that end at k. This gives, for each
word, the count at every prefix, with and without the word's end mark; a text's prefix counts are the running total of
its words plus the prefix counts of the word at the cut. ``RunningCounts`` stores the totals, ``PrefixCounts`` the count at
every character; both answer how many tokens a text has and what its longest prefix within a budget is from these numbers,
without encoding anything again.

Words recur, so the results of words of up to CACHED_CHARS characters are kept in bounded caches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice, zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches
from tidemark.llm.packing import byte_of_symbol

#: Entries of each cache of a Python worker; a full cache is emptied.
CACHE_ENTRIES = 300_000
CACHED_CHARS = 40

# Character classes up to U+024F as the vocabulary's splitting pattern sees them; texts with other
# characters are split by the tokenizer library.
_SPACE = "\\t-\\r \\x85\\xa0"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_OUTSIDE = re.compile("[^\\x00-\\x1b\\x20-\\u024f]")
_CHUNK = re.compile(r"\S+")


class PrefixCounter:
    """Counts for a byte-level BPE vocabulary file (tokenizers .json) whose words carry an end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.library = Tokenizer.from_file(path)
        self.symbols = {b: c for c, b in byte_of_symbol().items()}
        self.longest = max(len(t) for t in self.vocab)
        self.specials = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.special_texts = {t["content"] for t in spec["added_tokens"]}
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}

    # --- words -------------------------------------------------------------------------------------------------

    def _merged(self, parts: list[str]) -> list[str]:
        """Plain BPE of a few symbols; only used to judge whether tokens may stand alone or side by side."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def _split(self, token: str) -> list[str]:
        if self.mark and token.endswith(self.mark) and len(token) > len(self.mark):
            body = token[: -len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether BPE leaves ``token`` as it is after ``last`` (at a word's start, if that is -1)."""
        parts = self._split(self.names[token])
        kept = self._merged(parts if last < 0 else [*self._split(self.names[last]), *parts])
        known = kept == ([self.names[token]] if last < 0 else [self.names[last], self.names[token]])
        if len(self.pairs) >= 2 * CACHE_ENTRIES:
            self.pairs.clear()
        self.pairs[(last << 20) + token] = known
        return known

    def spelled(self, word: str) -> str:
        return word if word.isascii() and word.isalpha() else "".join([self.symbols[b] for b in word.encode("utf-8")])

    def _table(self, symbols: str) -> tuple[list[int], list[int]]:
        """Last token and token count of every prefix of a word of byte symbols, without the end mark."""
        lasts, counts, near = [-1], [0], 0
        for end in range(1, len(symbols) + 1):
            near = self._begin(symbols, lasts, end, near, "")
            lasts.append(self.vocab[symbols[near:end]])
            counts.append(counts[near] + 1)
        return lasts, counts

    def _begin(self, symbols: str, lasts: list[int], end: int, near: int, mark: str) -> int:
        """Where the last token of symbols[:end] (+ mark) begins; ``near``, where the token before began, is tried first."""
        find, pairs = self.vocab.get, self.pairs
        for begins in (range(near, end), range(near - 1, max(-1, end - self.longest - 1), -1)):
            for begin in begins:
                token = find(symbols[begin:end] + mark)
                if token is not None:
                    known = pairs.get((lasts[begin] << 20) + token)
                    if known or known is None and self._may_follow(lasts[begin], token):
                        return begin
        raise ValueError(f"the vocabulary can't spell {symbols!r}")

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of every prefix of one word, each as a word of its own (0 for the empty one), by bytes."""
        symbols = self.spelled(word)
        lasts, counts = self._table(symbols)
        near = lambda k: max(0, k - self.longest)  # noqa: E731  no token is longer, so a word's cost is in proportion to its length
        return [0, *[counts[self._begin(symbols, lasts, k, near(k), self.mark)] + 1 for k in range(1, len(symbols) + 1)]]

    def word_count(self, word: str) -> int:
        """Tokens of one word as split from a text."""
        count = self.words.get(word)
        if count is None:
            symbols = self.spelled(word)
            lasts, counts = self._table(symbols[:-1])
            count = counts[self._begin(symbols, lasts, len(symbols), 0 if len(symbols) < 4 else len(symbols) - 4, self.mark)] + 1
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[word] = count
        return count

    # --- texts -------------------------------------------------------------------------------------------------

    def normalised(self, text: str) -> str:
        if _OUTSIDE.search(text):
            return self.library.normalizer.normalize_str(text)
        lowered = unicodedata.normalize("NFC", text).lower()
        return self.library.normalizer.normalize_str(text) if _OUTSIDE.search(lowered) else lowered

    def split(self, normal: str) -> list[tuple[int, int]]:
        """Begin and end of each word of a normalised text."""
        if _OUTSIDE.search(normal):
            return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [m.span() for m in _WORD.finditer(normal)]

    def _chunk_count(self, chunk: str) -> int:
        """Tokens of a stretch of Latin text without white space."""
        count = self.chunks.get(chunk)
        if count is None:
            count = sum(map(self.word_count, _WORD.findall(chunk)))
            if len(chunk) <= CACHED_CHARS:
                if len(self.chunks) >= CACHE_ENTRIES:
                    self.chunks.clear()
                self.chunks[chunk] = count
        return count

    def _has_specials(self, text: str) -> bool:
        return "<|" in text and self.specials.search(text) is not None

    def running(self, text: str | None) -> RunningCounts | PrefixCounts:
        """The stored totals of a whole text; special strings in it count as the library counts them."""
        text = text or ""
        if self._has_specials(text):
            return self.prefixes(text)
        normal = self.normalised(text)
        if _OUTSIDE.search(normal):
            spans = self.split(normal)
            return RunningCounts(self, normal, list(accumulate(self.word_count(normal[a:b]) for a, b in spans)), spans)
        return RunningCounts(self, normal, list(accumulate(map(self._chunk_count, normal.split()))))

    def count(self, text: str | None) -> int:
        return self.running(text).total()

    def _plain_prefixes(self, normal: str) -> np.ndarray:
        """Counts at every prefix of a normalised text, special strings being ordinary text."""
        counts = np.zeros(len(normal) + 1, np.int64)
        total = at = 0
        for begin, end in self.split(normal):
            counts[at : begin + 1] = total
            word = normal[begin:end]
            if word[0] == "'":  # cut contractions split otherwise than whole ones
                for k in range(1, len(word)):
                    counts[begin + k] = total + sum(self.word_count(word[a:b]) for a, b in self.split(word[:k]))
            else:
                bytes_before = np.cumsum([0, *[len(x.encode("utf-8")) for x in word]])
                counts[begin : end + 1] = total + np.array(self.word_prefixes(word))[bytes_before]
            total += self.word_count(word)
            counts[end] = total
            at = end
        counts[at:] = total
        return counts

    def prefixes(self, text: str | None) -> PrefixCounts:
        """Counts at every prefix of the normalised text. A special string is ordinary text until it is whole."""
        normal, counts, total = "", [np.zeros(1, np.int64)], 0
        parts = self.specials.split(text) if text and self._has_specials(text) else [text or ""]
        for plain, special in zip_longest(parts[::2], parts[1::2], fillvalue=""):
            part = self.normalised(plain + special)
            table = self._plain_prefixes(part) + total
            if special:
                table[-1] = total = total + self._plain_prefixes(self.normalised(plain))[-1] + 1
            else:
                total = table[-1]
            normal += part
            counts.append(table[1:])
        return PrefixCounts(normal, np.concatenate(counts))


class PrefixCounts:
    """The exact token count at every prefix of a text."""

    def __init__(self, normal: str, counts: np.ndarray):
        self.text, self.counts = normal, counts
        self.low = np.minimum.accumulate(counts[::-1])[::-1]

    def total(self) -> int:
        return int(self.counts[-1])

    def longest_within(self, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return self.text[: max(0, bisect_right(self.low.tolist(), budget) - 1)]


class RunningCounts:
    """The exact token count at the end of every chunk (or span) of a text; inside one the prefix table of its words."""

    def __init__(self, counter: PrefixCounter, normal: str, totals: list[int], spans: list[tuple[int, int]] | None = None):
        self.counter, self.text, self.totals, self.spans = counter, normal, totals, spans

    def total(self) -> int:
        return self.totals[-1] if self.totals else 0

    def longest_within(self, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        whole = bisect_right(self.totals, budget)
        if budget < 0 or whole == len(self.totals):
            return self.text if budget >= 0 else ""
        begin, end = self.spans[whole] if self.spans else next(islice(_CHUNK.finditer(self.text), whole, None)).span()
        before = self.totals[whole - 1] if whole else 0
        inside = PrefixCounts(self.text[begin:end], self.counter._plain_prefixes(self.text[begin:end]))
        return self.text[:begin] + inside.longest_within(budget - before)


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, fitting_chars (of the longest prefix within the limit).

    Null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are counted each; texts of any
    length are read whole; an empty table gives an empty result; other columns pass by, whatever their names.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes bigint, n_tokens bigint, fitting_chars bigint")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter(tokenizer_path)
        for texts in parts:
            rows = []
            for text in texts:
                stored = counter.running(text)
                total = stored.total()
                rows.append((len((text or "").encode("utf-8")), total, len(stored.text if total <= limit else stored.longest_within(limit))))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "fitting_chars"]).astype("int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), counted(F.col(text)).alias("c"))
    return rows.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.fitting_chars")
