import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SCHEMA, SPACE, components, documents, shingle_set
from tidemark.llm.candidates import cross_pairs, link_buckets, with_hubs
from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.fuzzy_lines import LEAST_AGREEING, SHINGLE, _sign, fuzzy_lines
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.shingles import character_sets, mix, shingle_sets, super_minhash


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).cache()


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(SPACE, "", r.text or "")].append(r)
    out = {}
    for norm, g in groups.items():
        best = max(g, key=lambda r: (len(r.text or ""), r.doc_id is not None, -(r.doc_id or 0)))
        out[norm] = (best.doc_id, len(g))
    return out


@pytest.mark.parametrize("digest", [lambda b: hashlib.sha256(b).hexdigest(), lambda b: hashlib.sha256(b).hexdigest()[:1]], ids=["sha256", "clashing"])
def test_exact_dedup(docs, digest):
    rows = docs.collect()
    want = brute_exact(rows)
    found = exact_dedup(docs, carry=["doc_id", "text"], digest=digest).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.keep_id, r.group_size) == want[re.sub(SPACE, "", r.text or "")]
    kept = defaultdict(int)
    for r in found:
        kept[re.sub(SPACE, "", r.text or "")] += r.kept
    assert set(kept.values()) == {1}  # also of rows that repeat
    assert all(r.keep_id == r.doc_id for r in found if r.kept)


def brute_near(rows):
    sets = [shingle_set(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return sets, components(sets, links)


def test_near_dedup_matches_brute_force(docs):
    rows = docs.collect()
    sets, label = brute_near(rows)
    lowest = defaultdict(list)
    for r, c in zip(rows, label):
        lowest[c].append(r.doc_id)
    by_text = {r.text: (len(s), min((x for x in lowest[c] if x is not None), default=None)) for r, s, c in zip(rows, sets, label) if s}
    found = near_dedup(docs, carry=["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    for r in found:
        if shingle_set(r.text):
            assert (r.n_shingles, r.component_id) == by_text[r.text]
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True)
    assert sum(r.kept for r in found) == len(set(label))


def test_large_mixed_buckets_lose_no_link(spark, monkeypatch):
    """Documents that are mostly one passage: many share every band, few pairs are links; blocks must find them all."""
    import random

    import tidemark.llm.candidates as candidates
    import tidemark.llm.set_links as module

    monkeypatch.setattr(module, "BLOCK_ELEMENTS", 2000)
    monkeypatch.setattr(candidates, "SMALL_BUCKET", 2)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{rng.random()}" for _ in range(rng.randint(6, 26))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.collect()
    _, label = brute_near(rows)
    want = {r.doc_id: c for r, c in zip(rows, label)}
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and near_dedup(empty).count() == 0 and fuzzy_lines(empty).count() == 0


def test_super_minhash_estimates_and_agrees_by_slice():
    rng = np.random.default_rng(1)
    a = mix(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], mix(rng.integers(0, 2**63, 100).astype(np.uint64))])
    both = np.concatenate([a, b])
    values = super_minhash(both, np.array([0, 400, 800]), 128)
    assert abs((values[0] == values[1]).mean() - 300 / 500) < 0.15
    assert np.array_equal(values[0], super_minhash(a[::-1].copy(), np.array([0, 400]), 128)[0])
    assert np.isinf(super_minhash(a[:0], np.array([0, 0]), 128)).all()
    for n in (1, 2, 9):  # each element owns a whole permutation: all slots are filled
        assert np.isfinite(super_minhash(a[:n], np.array([0, n]), 128)).all()


def test_shingle_sets_match_plain_sets(monkeypatch):
    import tidemark.llm.shingles as module

    texts = ["a b c d e f g", "A b c d e f g", "a b\tc", "", None, "a b c d e a b c d e a b c d e", " x ", "é " * 9]
    whole = shingle_sets(texts)
    monkeypatch.setattr(module, "CHUNK", 6)
    assert np.array_equal(whole[0], shingle_sets(texts)[0]) and np.array_equal(whole[1], shingle_sets(texts)[1])
    assert np.diff(whole[1]).tolist() == [len(shingle_set(t)) for t in texts]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_connected_components(spark, edges):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = components(list(range(26)), edges)
    assert found == {n: label[n] for e in edges for n in e}


def test_long_chain_is_one_component(spark):
    found = connected_components(spark.range(200).selectExpr("id AS a", "id + 1 AS b"))
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, 201)]


def test_buckets_lose_no_link(spark):
    """One bucket of points on a line, linked when close: most pairs of a hub fail, and all links must be found."""
    import pyspark.sql.functions as F

    points = {i: set(range(i * 3, i * 3 + 30)) for i in range(40)} | {i: set(range(1000 + i * 30, 1030 + i * 30)) for i in range(40, 80)}
    sets = spark.createDataFrame([(k, sorted(v)) for k, v in points.items()], "node bigint, shingles array<bigint>").cache()

    def compare(pairs, one_each=False):
        one, two = sets.selectExpr("node AS a", "shingles AS x"), sets.selectExpr("node AS b", "shingles AS y")
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(one, "a").join(two, "b").where(both * 100 >= (60 - both) * 75).select("a", "b")

    scratch = Scratch(spark)
    members = with_hubs(sets.select("node", F.lit(0).alias("weight"), F.lit(1).alias("bucket")), scratch)
    found = link_buckets(members, compare, lambda large: compare(cross_pairs(large)), scratch)
    label = {r.node: r.component for r in found.collect()}
    assert {label.get(i, i) for i in range(40)} == {0} and all(label.get(i, i) == i for i in range(40, 80))


def test_fuzzy_lines(spark):
    long = "the quick brown fox jumps over the lazy dog while seventeen grey geese watch from the far bank of the river"
    other = "an entirely different line about nothing in particular that shares no stretch with the first one at all today"
    rows = [(2, f"{long}\n\n{other}"), (1, f"  {long.upper()} \n{long.replace('lazy', 'hazy')}"), (3, f"{other}!\nshort\n\nshort"), (4, None), (5, ""), (3, f"{other}!\nshort\n\nshort"), (None, long), (6, "x" * 3000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, line string")
    found = fuzzy_lines(docs).collect()
    keeper = {(r.doc_id, r.line_no): ((r.component_doc_id, r.component_line_no), r.kept) for r in found if r.doc_id not in (3, None)}
    assert keeper[(2, 0)] == ((1, 0), False) and keeper[(1, 0)] == ((1, 0), True) and keeper[(1, 1)] == ((1, 0), False)
    assert keeper[(2, 1)] == ((2, 1), True) and keeper[(2, 2)] == ((2, 2), True)
    assert keeper[(4, 0)][1] and keeper[(5, 0)][1] and keeper[(6, 0)][1]
    three = [r for r in found if r.doc_id == 3]
    assert all((r.component_doc_id, r.component_line_no) == (2, 2) and not r.kept for r in three if r.line_no == 0)
    assert sum(r.kept for r in three if r.line_no in (1, 3)) == 1  # short lines that are equal
    assert sum(r.kept for r in three if r.line_no == 2) == 2  # empty lines all stay
    assert not any(r.kept for r in found if r.doc_id is None)


def test_fuzzy_lines_match_brute_force(docs):
    lines = [(r.doc_id, n, x.strip(" \t\x0b\x0c\r").lower()) for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect() for n, x in enumerate((r.text or "").split("\n"))]
    grams = [({x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)} or {x}) if x else set() for _, _, x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if grams[i] and grams[j] and 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j])]
    label = components(lines, links)
    found = fuzzy_lines(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    assert len(found) == len(lines) and sum(r.kept for r in found) == len(set(label))
    groups = defaultdict(set)
    for (d, n, _), c in zip(lines, label):
        groups[c].add((d, n))
    where = {place: min(g) for g in groups.values() for place in g}
    assert all((r.component_doc_id, r.component_line_no) == where[(r.doc_id, r.line_no)] for r in found)


def _grams(line):
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)} or {line}


def _alike(a, b):
    return len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b))


def _missed(pairs):
    """The share of pairs of lines that meet in no band or agree in too few slots."""
    bands, signature = _sign([line for pair in pairs for line in pair])
    lost = 0
    for i in range(0, len(bands), 2):
        agree = sum(x == y for x, y in zip(signature[i], signature[i + 1]))
        lost += agree < LEAST_AGREEING or not set(bands[i].tolist()) & set(bands[i + 1].tolist())
    return lost / len(pairs)


def test_character_sets_match_plain_sets():
    lines = ["abc", "x" * 30, "the quick brown fox", "été 日本 " * 9, "a", "0123456789", "01234567890", "abc"]
    sets, offsets = character_sets(lines, SHINGLE)
    assert np.diff(offsets).tolist() == [len(_grams(x)) for x in lines]
    assert np.array_equal(sets[offsets[0] : offsets[1]], sets[offsets[7] : offsets[8]])
    x, y = (set(sets[offsets[i] : offsets[i + 1]].tolist()) for i in (5, 6))
    assert len(x & y) == 1


def test_lines_that_differ_by_a_letter_meet():
    """Lines of few long words, of one long word and of many short ones, each with a letter more."""
    rng = np.random.default_rng(4)
    token = lambda n: "".join(rng.choice(list("abcdefghijkl"), n))
    lines = [" ".join(token(w) for _ in range(k)) for w, k in [(120, 1), (60, 2), (22, 3), (24, 10), (25, 10), (3, 40)] for _ in range(40)]
    assert _missed([(x, x + "q") for x in lines]) == 0


def test_bands_of_fuzzy_lines_miss_few_short_pairs():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
    pairs = []
    while len(pairs) < 4000:
        one = [word() for _ in range(rng.randint(8, 30))]
        two = list(one)
        for _ in range(rng.randint(1, 3)):
            two[rng.randrange(len(two))] = word()
        if 0.75 <= _alike(" ".join(one), " ".join(two)) <= 0.85:
            pairs.append((" ".join(one), " ".join(two)))
    assert _missed(pairs) <= 1e-3


def test_bands_of_fuzzy_lines_see_more_than_word_beginnings():
    import random

    rng = random.Random(6)
    token = lambda n: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(n))
    lines = [f"{token(22)} {token(22)} {token(22)}" for _ in range(2000)]
    assert _missed([("x" + line[1:], "y" + line[1:]) for line in lines]) == 0


def test_short_lines_are_linked_whatever_their_signatures_say(spark):
    """Of 12, 13 and 14 characters and one more: similarities of 0.75, 0.8 and 0.83."""
    import random

    rng = random.Random(8)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for n in (12, 13, 14):
        lines = [token(n) for _ in range(1500)]
        docs = spark.createDataFrame([(2 * i + k, x + "q" * k) for i, x in enumerate(lines) for k in (0, 1)], "doc_id bigint, text string")
        kept = fuzzy_lines(docs).where("kept").count()
        assert 1500 <= kept <= 1502


def test_links_of_near_dedup_are_between_words_not_hashes(spark):
    """Thue-Morse words collide under any polynomial hash modulo 2**64; and a collision of any hash makes no link."""
    from tidemark.llm.set_links import _links
    from tidemark.llm.shingles import shingle_sets, word_shingles

    one = "ab"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == {1: 1, 2: 2, 3: 1}
    same = lambda texts: (np.arange(len(texts), dtype=np.uint64) * np.uint64(0), np.arange(len(texts) + 1))
    assert _links(["a b", "a b"], ["a c", "A  b"], same, word_shingles) == [False, True]
    assert len(word_shingles("a b c d e f")) == np.diff(shingle_sets(["a b c d e f"])[1])[0] == 2


@pytest.mark.parametrize("slots", [3, 7, 42, 128])
def test_agreement_of_signatures_is_counted_without_python(spark, slots):
    from tidemark.llm.set_links import agreeing, words

    rng = np.random.default_rng(slots)
    ones = rng.integers(0, 256, (60, slots)).astype(np.uint8)
    twos = np.where(rng.random((60, slots)) < 0.5, ones, rng.choice([0, 1, 127, 128, 255], (60, slots))).astype(np.uint8)
    rows = [(i, x.tobytes(), y.tobytes()) for i, (x, y) in enumerate(zip(ones, twos))]
    table = spark.createDataFrame(rows, "i int, x binary, y binary").select("i", words("x", slots).alias("x"), words("y", slots).alias("y"))
    found = table.select("i", agreeing("x", "y", slots).alias("n"))
    assert {r.i: r.n for r in found.collect()} == dict(enumerate((ones == twos).sum(axis=1).tolist()))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_count_slots_that_differ():
    import pandas as pd

    from tidemark.llm.set_links import Agreement, _Block

    rng = np.random.default_rng(2)
    signs = rng.choice([0, 1, 127, 128, 255], (9, 42)).astype(np.uint8)
    rows = pd.DataFrame({"node": range(9), "component": range(9), "home": 0, "low": 0, "high": 0, "bucket": 5, "signature": [x.tobytes() for x in signs], "bands": [[5]] * 9, "text": ["a"] * 9})
    block = _Block(rows, lambda lines: character_sets(lines, SHINGLE), _grams, Agreement(42, 17))
    every = np.arange(9)
    assert (block.differing(every, every) == (signs[:, None] != signs[None]).sum(axis=2)).all()


def test_character_sets_of_mixed_lines():
    """Short and long lines in any order, letters beyond the table, shingles that repeat: sets as Python has them."""
    lines = ["", "abc", "x" * 30, "\U0001F600" * 12, "", "ab" * 40, "日本語" * 9, "é", "0123456789", "a" * 9]
    sets, offsets = character_sets(lines, SHINGLE)
    parts = [sets[a:b] for a, b in zip(offsets, offsets[1:])]
    assert [len(p) for p in parts] == [len(_grams(x)) for x in lines] and all((np.diff(p.astype(object)) > 0).all() for p in parts)
    named = {g: h for x, p in zip(lines, parts) if len(x) <= SHINGLE for g, h in zip(_grams(x), p.tolist())}
    assert len(set(named.values())) == len(named)
    assert len(character_sets([], SHINGLE)[0]) == 0


def test_blanks_are_taken_from_both_ends_only(spark):
    from tidemark.llm.fuzzy_lines import _stripped

    lines = ["", " ", "a b", " a", "a\t", "\x0ba \tb\x0c", "\r\r", "\u00a0a\u00a0", " é ", "a\u2003"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    assert {r.i: r.x for r in rows.select("i", _stripped(rows.line).alias("x")).collect()} == {i: x.strip(" \t\x0b\x0c\r") for i, x in enumerate(lines)}
