"""Decontamination, whitening and the divergence audit against brute force, with every awkward case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents
from tidemark.llm import decontamination, source_divergence
from tidemark.llm import queries as registered
from tidemark.llm.decontamination import Words, decontaminate
from tidemark.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination ---------------------------------------------------------------------------------------------------


def contamination(texts, items):
    """(n_words, ranges of hit words, item ids) of each text, by comparing every window at every place."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORDS.findall(lowered(text))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, held = WORDS.findall(lowered(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    held |= found
        ranges = [(i, min(k for k in range(i, len(words) + 1) if k not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((len(words), ranges, sorted(held)))
    return out


def benchmark_rows(texts):
    long, copied = texts[0], " ".join(texts[1].split()[:12])
    return [(1, long), (2, copied), (3, copied), (3, "x"), (4, "one two"), (5, None), (6, " .,!"), (7, "no document says just this sentence of more than ten words at all"),
            (8, "ÉTÉ ça où 日本語"), (None, texts[2]), (9, "b b b b b b b b b b b b"), (2, copied), (10, "y y y y y y")]


def test_decontaminate_matches_brute_force(spark):
    docs = documents(spark)
    texts = [r.text for r in docs.collect()]
    more = ["b " * 40, "the " * 3 + "y " * 6, "Été Ça: où—日本語", "ÉTÉ ça, où 日本語!", "a-b_c\0d3", texts[0].upper().replace(" ", " ... ")]
    docs = docs.unionByName(spark.createDataFrame([(900 + i, t, None, None, None, None, None, None) for i, t in enumerate(more)], SCHEMA))
    items = benchmark_rows(texts)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, n_words string")
    found = decontaminate(docs, bench, carry=["doc_id", "text", "kept", "uid"]).collect()
    expected = Counter((r.doc_id, r.text, repr(c)) for r, c in zip(docs.collect(), contamination([r.text for r in docs.collect()], items)))
    assert Counter((r.doc_id, r.text, repr((r.n_words, [(h.begin, h.end) for h in r.hits], list(r["items"])))) for r in found) == expected
    assert all(r.n_hit == sum(h.end - h.begin for h in r.hits) for r in found) and sum(r.n_hit > 0 for r in found) > 10
    ids = {r.doc_id: r["items"] for r in found}
    assert ids[900] == ["9"] and ids[901] == ["10"] and ids[903] == ["8"] and ids[902] == []


@pytest.mark.parametrize("docs_there, items_there", [(True, False), (False, True), (False, False)])
def test_decontaminate_empty_sides(spark, docs_there, items_there):
    docs = spark.createDataFrame([(1, "some words here")] if docs_there else [], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "words")] if items_there else [], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, items).collect()] == ([(3, 0, [])] if docs_there else [])


def test_decontaminate_long_texts(spark):
    """A text of some MB, a word longer than a piece, and a match that lies across the edge of two pieces."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400_000)]
    passage = words[131_060:131_085]  # about PIECE bytes from the start
    assert abs(sum(len(w) + 1 for w in words[:131_072]) - decontamination.PIECE) < 8
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "q" * 3_000_000 + " " + " ".join(passage)), (3, "q" * 3_000_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "q" * 3_000_000)], "item_id bigint, text string")
    found = {r.doc_id: (r.n_words, [(h.begin, h.end) for h in r.hits], r["items"]) for r in decontaminate(docs, items).collect()}
    assert found == {1: (400_000, [(131_060, 131_085)], ["1"]), 2: (26, [(0, 26)], ["1", "2"]), 3: (1, [(0, 1)], ["2"])}


def test_words_and_hashes():
    texts = ["Ab-c9 \0É", None, "", "ab", "ab c9"]
    words = Words(texts)
    assert [words.said(i, i + 1) for i in range(len(words.starts))] == ["ab", "c9", "É", "ab", "ab", "c9"]
    assert words.owner.tolist() == [0, 0, 0, 3, 4, 4] and words.hashes[0] == words.hashes[3] == words.hashes[4] != words.hashes[1]
    thue = "ab"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    one, two = Words([thue, thue.translate(str.maketrans("ab", "ba"))]).hashes
    assert one != two
    places, tokens = Words(["a b c", "b c a b c"]).shingles(2)
    assert places.tolist() == [0, 1, 3, 4, 5, 6] and tokens[0] == tokens[4] and tokens[1] == tokens[2] == tokens[5]


# --- whitening ---------------------------------------------------------------------------------------------------------


def test_factorisation():
    rng = np.random.default_rng(2)
    for size, rank in ((1, 1), (2, 2), (7, 7), (24, 24), (9, 4), (5, 0)):
        base = rng.normal(size=(size, rank)) * np.logspace(0, -2, rank) if rank else np.zeros((size, 1))
        v = base @ base.T
        factor = pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, rtol=0, atol=1e-13)
        values, vectors = one_sided_jacobi(factor)
        assert np.allclose(values, np.linalg.svd(base, compute_uv=False)[:rank] ** 2 if rank else [], rtol=1e-6, atol=0)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12) and np.all(np.diff(values) <= 0)
        assert np.allclose(vectors * values @ vectors.T, v, atol=1e-13)


def vectors(rng, n, width):
    return (rng.normal(size=(n, width)) * np.linspace(1, 0.2, width)).astype(np.float32).tolist()


def test_whiten_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, v, 0, "x") for i, v in enumerate(vectors(rng, 300, 12))]
    bad = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0] * 5, [0.5] * 11 + [None]]
    rows += [(1000 + i, v, 0, "y") for i, v in enumerate(bad)] + [(5, rows[5][1], 0, "z"), (None, rows[6][1], 0, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int, whitened string")
    good = [r for r in rows if r[1] is not None and len(r[1]) == 12 and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.floor(1024 * np.array([r[1] for r in good], np.float32).astype(float)).astype(int) + 100_000
    n, total = len(x), x.sum(axis=0)
    whole = n * x - total
    v = (whole.astype(object).T @ whole.astype(object) / n**3).astype(float)
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    true = (x - total / n) @ axes / np.sqrt(values)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = defaultdict(dict)
    for r in registered.op12_whiten(spark, str(tmp_path)).collect():
        found[r.vec_id, r.deviation].setdefault(r.component, []).append((r.n, r.whitened, r.explained, r.identity_error))
    assert set(found) == {(r[0], int((w.astype(object) ** 2).sum())) for r, w in zip(good, whole)} and all(sorted(f) == list(range(1, 9)) for f in found.values())
    sign = None
    for r, w, t in zip(good, whole, true):
        parts = found[r[0], int((w.astype(object) ** 2).sum())]
        mine = np.array([parts[k + 1][0][1] for k in range(8)])
        sign = np.sign(mine * t[:8]) if sign is None else sign
        assert np.allclose(mine * sign, t[:8], atol=1e-9)
        assert all(p[0][0] == n and abs(p[0][2] - values[k - 1] / np.trace(v)) < 1e-9 and p[0][3] < 1e-9 for k, p in parts.items())
    assert len(found[5, next(d for i, d in found if i == 5)][1]) == 2  # repeated rows stay


@pytest.mark.parametrize("rows, components", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]], 1), ([[0.0], [1.0]], 1)])
def test_whiten_few_components(spark, rows, components):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    found = whiten(table).collect()
    assert [len(r.whitened) for r in found] == [components] * (len(rows) if components else 0)
    assert all(r.identity_error < 1e-9 and abs(sum(r.explained) - 1) < 1e-9 for r in found)


def test_whiten_sums_are_exact_for_large_entries(spark):
    rows = [[3e9, 1.0], [-3e9, 2.0], [1e9 + 0.25, -5.0]]
    found = whiten(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>").where("vec_id < 0"))
    assert found.count() == 0
    with pytest.raises(Exception, match="overflow"):
        whiten(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")).collect()
    with pytest.raises(Exception, match="overflow"):
        whiten(spark.createDataFrame([(0, [1e20]), (1, [0.0])], "vec_id bigint, embedding array<double>")).collect()
    near = [[x / 1e4 for x in v] for v in rows]
    found = whiten(spark.createDataFrame([(i, v) for i, v in enumerate(near)], "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in near]
    assert [r.deviation for r in found] == [sum((3 * a - s) ** 2 for a, s in zip(v, map(sum, zip(*x)))) for v in x]


# --- source divergence -------------------------------------------------------------------------------------------------


def divergence(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((r[0] or "", r[1] or "", r[2]) for r in rows):
        terms = Counter(TERMS.findall(lowered(text)))
        groups.add((lang, source))
        counts[lang, source] += terms
        docs[lang].update(terms.keys())
    out = []
    for lang, source in groups:
        kept = sorted((t for t in docs[lang] if docs[lang][t] >= 10), key=lambda t: t.encode())
        sources = sorted(s for x, s in groups if x == lang)

        def shares(of):
            c = [sum(counts[lang, s][t] for s in of) for t in kept]
            return [1 + 10**9 * (k + 2) // (sum(c) + 2 * len(kept)) for k in c], c

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, c = shares([source])
        q, _ = shares(sources)
        pairs = sorted((-sum(map(f, p, shares([s])[0])), s.encode()) for s in sources if s != source)
        terms = sorted((-f(a, b), t.encode()) for t, a, b, k in zip(kept, p, q, c) if k and a > b)[:10]
        for part, found in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audit_rows(seed=7):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "ÉTÉ", "日本語", "a_b", "x9y", *["".join(rng.choice("abcde") for _ in range(3)) for _ in range(60)]]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "ß", "z"])
        rows.append((lang, source, " ".join(rng.choice(vocabulary[: 20 + 10 * (i % 5)]) for _ in range(rng.randint(0, 40)))))
    return rows + [("fr", "s1", "rare"), ("fr", "s2", None), ("fr", None, " 12 "), ("it", "only", "one"), ("de", "empty", ""), ("de", "blank", "12 \0 !"), ("en", "s1", None), rows[0], rows[0]]


@pytest.mark.parametrize("cells", [source_divergence.CELLS, 8])
def test_source_divergence_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(source_divergence, "CELLS", cells)  # many shards of a language, and one
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string").repartition(5)
    found = source_divergence.source_divergence(docs).collect()
    assert sorted(tuple(r) for r in found) == divergence(rows)


def test_source_divergence_empty(spark):
    assert source_divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_partial_counts_of_long_texts(monkeypatch):
    """Texts longer than a slice count once as documents; a full table is emitted and grown anew."""
    monkeypatch.setattr(source_divergence, "SLICE", 64)
    monkeypatch.setattr(source_divergence, "HELD", 40)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc  É1") for _ in range(n)) for n in (500, 3, 63, 64, 65, 200)] + ["x" * 300, None, "", "y" * 100 + " y"]
    batches = [pa.RecordBatch.from_pydict({"lang": ["l"] * 5, "source": ["s"] * 5, "text": pa.array(texts[i : i + 5], pa.string())}) for i in (0, 5)]
    found, docs = Counter(), Counter()
    for b in source_divergence._counted(iter(batches)):
        for r in b.to_pylist():
            found[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    terms = [TERMS.findall(lowered(t)) for t in texts]
    assert +found == Counter(t for x in terms for t in x)
    assert docs - Counter({"": 10}) == Counter(t for x in terms for t in set(x)) and docs[""] == 10


def test_shares_by_long_division():
    rng = random.Random(3)
    for _ in range(300):
        kept, total = rng.randint(1, 10**9), rng.randint(0, 9 * 10**13)
        count = rng.randint(0, total)
        assert source_divergence.shares(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_decontaminate_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "z")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, "b c"), (9, "a")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.doc_id: r for r in registered.op11_decontaminate(spark, str(tmp_path)).collect()}
    assert (found[1].n_hit, found[1].n_items, found[1].items_sha256, found[1].contaminated) == (3, 2, hashlib.sha256(b"10,9").hexdigest(), True)
    assert (found[2].n_hit, found[2].items_sha256) == (0, hashlib.sha256(b"").hexdigest())
