import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, words
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import ByteConvNet, fit_language_id, identify_language
from tidemark.llm.mixing import mix_sources
from tidemark.llm.multi_index import cell_scores, fit_multi_index, search
from tidemark.llm.toxicity import FEATURES, BoostedTrees, Lexicon, features, fit_toxicity, isotonic, score_toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_network_tables_give_the_plain_forward_pass():
    net = ByteConvNet(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (30, 128)).astype(np.uint8)
    plain = net._softmax(net._pooled(x)[1])
    assert np.allclose(plain, net.probabilities(x), atol=1e-4)


def test_network_gradients():
    net = ByteConvNet(["a", "b"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (6, 128)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -np.log(net._softmax(net._pooled(x)[1])[np.arange(6), y]).mean()
    g = net.gradients(x, y)
    for name in ("W3", "D", "E"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        before, step = net.p[name][at], 1e-6
        net.p[name][at] = before + step
        up = loss()
        net.p[name][at] = before - step
        assert abs((up - loss()) / (2 * step) - g[name][at]) < 1e-4
        net.p[name][at] = before


@needs_data
def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify_language(docs, fit_language_id(docs), carry=["doc_id", "lang"]).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_id_cases(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("aaaa bbbb", "x"), ("cccc dddd", "y")] * 40 + [(None, "x"), ("", "y"), ("123 !?", "x"), ("aaaa bbbb", None), ("aaaa bbbb " * 5000, "x")])] + [(None, "cccc dddd", None)], "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    found = identify_language(docs, fit_language_id(docs), carry=["doc_id", "text"]).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in found if r.text in (None, "", "123 !?"))
    assert {r.lang_pred for r in found if r.text and r.text.startswith("aaaa")} == {"x"} and {r.lang_pred for r in found if r.text and r.text.startswith("cccc")} == {"y"}
    empty = docs.limit(0)
    assert identify_language(empty, fit_language_id(empty)).count() == 0
    assert {r.lang_pred for r in identify_language(docs, fit_language_id(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_toxicity_learns_and_leaves_clean_texts_alone(spark):
    import random

    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        said = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                said[rng.randrange(len(said))] = rng.choice(["zorbian", "zorbical", "zorbment", "idiot"])
        rows.append((i, " ".join(said), "clash"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, None), (1001, "", None), (None, "x", None), (1002, "zorbial " * 30000, None)], "doc_id bigint, text string, label string")
    model = fit_toxicity(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id bigint, toxic int"))
    found = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    held = [i for i in range(600) if found[i].held_out]
    assert np.mean([found[i].predicted == (i % 8 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert found[1000].score == found[1001].score and found[1000].predicted == 0 and found[1002].predicted == 1
    nothing = fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in score_toxicity(docs, nothing).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_isotonic_is_the_best_rising_fit():
    margin, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    x, rate = isotonic(margin, y, np.ones(6))
    assert np.allclose(np.interp(margin, x, rate), [0, 1 / 3, 1 / 3, 1 / 3, 1, 1])


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1500, 16))
    rows[100:160] = rows[100]  # equal vectors: ties go to smaller ids
    data = [(i, [float(v) for v in r], "c") for i, r in enumerate(rows)]
    bad = [(2001, None, "c"), (2002, [0.0] * 16, "c"), (2003, [float("nan")] * 16, "c"), (2004, [None, *[1.0] * 15], "c"), (2005, [1.0, 2.0], "c"), (None, [1.0] * 16, "c"), (2020, [float("inf")] * 16, "c"), data[40], data[41]]
    df = spark.createDataFrame([*data, *bad], "vec_id bigint, embedding array<double>, score string").repartition(4)
    found = search(df, lambda v: v % 20 == 0).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i in range(1500) if i % 20 == 0}
    hits = 0
    for q, got in by_query.items():
        got.sort(key=lambda r: r.rank)
        exact = (rows * rows[q]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(1500), -exact)) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in got})
        assert [r.rank for r in got] == list(range(1, 21)) and all(abs(r.score - exact[r.vec_id]) < 1e-9 for r in got)
        order = [(-r.score, r.vec_id) for r in got]
        assert order == sorted(order)
    assert hits / (20 * len(by_query)) >= 0.9
    assert search(df.limit(0), lambda v: v % 20 == 0).count() == 0
    few = search(df.where("vec_id < 4 OR vec_id = 20"), lambda v: v % 20 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, k) for k in range(1, 5)] + [(20, k) for k in range(1, 5)]


def test_walk_visits_pairs_by_summed_distance():
    index = fit_multi_index(np.random.default_rng(6).normal(size=(300, 8)))
    q = np.random.default_rng(7).normal(size=8)
    order = list(index.walk(q, np.ones((64, 64), int), 1e9))
    near = [(index.first @ q[:4])[i] + (index.second @ q[4:])[j] for i, j in order]
    assert len(set(order)) == 64 * 64 and all(a >= b - 1e-9 for a, b in zip(near, near[1:]))


def test_blocks_score_met_cells_only():
    rng = np.random.default_rng(8)
    index = fit_multi_index(rng.normal(size=(400, 8)))
    rows = rng.normal(size=(300, 8))
    first, second = index.cells(rows)
    order = np.lexsort((second, first))
    rows, first, second = rows[order], first[order], second[order]
    asked, counts = rng.normal(size=(9, 8)), np.zeros((64, 64), int)
    np.add.at(counts, (first, second), 1)
    met = [set(index.walk(q, counts, 60)) for q in asked]
    masks = np.array([[sum(1 << j for i, j in cells if i == c) for c in range(64)] for cells in met], np.uint64)
    scores, made = cell_scores(asked, masks, rows, first, second)
    wanted = np.array([[(i, j) in cells for i, j in zip(first, second)] for cells in met])
    assert np.array_equal(np.isfinite(scores), wanted) and np.allclose(scores[wanted], (asked @ rows.T)[wanted])
    assert made == wanted.sum() < len(asked) * len(rows) / 2


def test_trees_split_best():
    """A tree of one split against all splits of all features."""
    rng = np.random.default_rng(9)
    x, slope, bend = rng.integers(0, 32, size=(200, 3)), rng.normal(size=200), rng.uniform(0.1, 0.3, 200)
    feature, cut, leaf = BoostedTrees._grow(x, slope, bend)

    def worth(left):
        return sum(slope[side].sum() ** 2 / (bend[side].sum() + 1) for side in (left, ~left))

    best = max((worth(x[:, f] <= c), -f, -c) for f in range(3) for c in range(31))
    assert np.isclose(worth(x[:, feature[0]] <= cut[0]), best[0])
    node = np.zeros(200, int)
    for level in range(3):
        at = 2**level - 1 + node
        node = 2 * node + (x[np.arange(200), feature[at]] > cut[at])
    assert all(np.isclose(leaf[k], -0.2 * slope[node == k].sum() / (bend[node == k].sum() + 1)) for k in range(8))


def test_features_are_plain_counts():
    text = "You IDIOT, zorb zorbing! f00l #$% 42 é you"
    found = features(text, Lexicon({"idiot": 3.0, "zorb": 2.0}, {"zorb": 1.0}))
    words, letters = text.count(" ") + 1, sum(c.isalpha() for c in text)
    marks = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    want = [np.log1p(2), np.log1p(1), 2 / words, 1 / words, 3.0, 6.0, 3 / words, 3 / 3, sum("A" <= c <= "Z" for c in text) / letters, marks / len(text), 1 / len(text), 2 / words, sum(c.isdigit() for c in text) / len(text), np.log1p(len(text))]
    assert np.allclose(found, want)
    assert len(features(None, Lexicon({}, {}))) == len(features("x" * 100_000, Lexicon({}, {}))) == FEATURES


def test_a_row_that_fills_the_table(spark):
    rows = [(7, "one two three four", "a")] * 300 + [(i, "w " * (i % 50 + 1), "ab"[i % 2]) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    found = mix_sources(docs).collect()
    assert len(found) == 600 and {r.doc_id for r in found} == {r[0] for r in rows}
    for size in {r.source_size for r in found}:
        part = [r for r in found if r.source_size == size]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 25
    assert len({r.taken for r in found if r.doc_id == 7}) == 2  # copies have random numbers of their own
    assert sum(r.kept for r in exact_dedup(docs).collect() if r.doc_id == 7) == 1


def test_longer_documents_are_likelier(spark):
    docs = spark.createDataFrame([(i, "w " * (10 if i % 2 else 400), "a") for i in range(2000)] + [(5000, "w " * 3_000_000, "b")], "doc_id bigint, text string, source string")
    found = [r for r in mix_sources(docs, weights=(1, 9), budget=0.9).collect() if r.doc_id < 5000]
    rate = found[0].target / found[0].source_size
    rates = [np.mean([r.taken > 0 for r in found if r.size == n]) for n in (10, 400)]
    worth = {n: 1000 * n // (n + 100) for n in (10, 400)}
    mean = (worth[10] * 10 + worth[400] * 400) / 410
    expected = [rate + min(rate, 1 - rate) * (worth[n] - mean) / 1000 for n in (10, 400)]
    assert rate < 1 and np.allclose(rates, expected, atol=0.05) and rates[1] > rates[0] + 0.05


def test_mixing(spark):
    docs = documents(spark, n=400).repartition(3)
    rows = docs.collect()
    found = mix_sources(docs, carry=["doc_id", "text", "source"]).collect()
    again = mix_sources(docs.repartition(7), carry=["doc_id", "text", "source"]).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in found) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert len(found) == len(rows) and all(r.size == len(words(r.text)) and r.taken in (0, r.size, 2 * r.size) for r in found)
    sizes, taken, target = {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.source_size == sum(x.size for x in found if x.source == r.source)
    order = [s for s in sorted(x for x in sizes if x is not None)] + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = {target[s] / weight[s] for s in order if target[s] < 2 * sizes[s] - 1e-6}
    assert max(level) - min(level) < 1e-6 and abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(target[s] <= max(level) * weight[s] + 1e-6 for s in order)
    largest = {s: max(r.size for r in found if r.source == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in order)
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.taken for r in mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")).collect()} == {0}


def test_languages_of_many_values_and_a_long_text(spark):
    """A column of lang with a value for each row, and a text whose windows are scored in slices."""
    from tidemark.llm import language_id as module

    rows = [(i, "le chat et la souris " * 3 if i % 2 else "the cat and the mouse " * 3, f"l{i}") for i in range(40)]
    model = module.fit_language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert 20 <= len(model.classes) <= 40
    texts = ["the cat and the mouse " * 3, "le chat et la souris " * 30_000]
    whole = model.predict(texts)
    size, module.SCORED = module.SCORED, 16
    try:
        sliced = model.predict(texts)
    finally:
        module.SCORED = size
    assert sliced[0] == whole[0] and all(abs(a - b) < 1e-6 for a, b in zip(whole[1], sliced[1]))
