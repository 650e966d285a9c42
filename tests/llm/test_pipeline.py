import re
from collections import Counter

import corpus_pipeline
import pytest

from tests.llm.helpers import SCHEMA, SPACE, components, documents, shingle_set
from tidemark.llm.common import materialise


def test_stages_by_brute_force(spark):
    docs = documents(spark).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    columns = docs.columns

    told = materialise(stages["language_id"](spark, docs, ""), "test")
    assert told.columns == columns
    assert Counter(r.text for r in told.collect()) == Counter(r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text))

    exact = materialise(stages["exact_dedup"](spark, told, ""), "test")
    norm = lambda r: re.sub(SPACE, "", r.text or "")
    assert exact.columns == columns and Counter(map(norm, exact.collect())) == Counter(set(map(norm, told.collect())))

    near = materialise(stages["near_dedup"](spark, exact, ""), "test")
    rows = exact.collect()
    sets = [shingle_set(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert near.columns == columns and near.count() == len(set(components(sets, links)))

    mixed = materialise(stages["mix_sources"](spark, near, ""), "test")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies.values()) <= {1, 2} and set(copies) <= {r.doc_id for r in near.collect()}

    packed = stages["packing"](spark, mixed, "").collect()
    taken = {}  # every place of every sequence is filled once, from 0 on, and every copy of a document wholly
    for r in packed:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(taken) == list(range(len(taken)))
    for n, pieces in taken.items():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends == 2048 or n == max(n for n, p in taken.items() if sum(x for _, x in p) < 2048)
    for doc_id, count in copies.items():
        mine = [r for r in packed if r.doc_id == doc_id]
        if doc_id is not None:
            assert sum(r.length for r in mine) == sum({r.doc_tokens for r in mine}) * count


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "test")
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["op1_multi_index", "pipeline"])
def test_registered(name):
    from tidemark.llm.queries import queries

    assert name in queries() and sum(k.startswith("op") for k in queries()) == 10
