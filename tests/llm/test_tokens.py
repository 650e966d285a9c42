import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents
from tidemark.llm.chat_tree import chat_tree, escape, parse, read_back, unescape
from tidemark.llm.packing import Encoder, closest_multiset, minimum_bin_slack, pack, place
from tidemark.llm.token_counts import PrefixCounter, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(WORDS)


TRICKY = ["", "Don't they'RE 'Ll x're  ½²ª_a", "İstanbul ΣΑΣ σας", "a<|endoftext|>b <|startoftext|>", "日本語 é\u200b", "\x1c\x1d a\x85b\xa0c", "!!'s 'd''ve", "ß ŉ ǰ \x00\x01", "K ǅ 🙂🙂", "'", "x" * 500]


@pytest.mark.parametrize("text", TRICKY)
def test_counts_and_ids_are_the_libraries(libraries, counter, text):
    assert counter.count(text) == len(libraries[1].encode(text, add_special_tokens=False).ids)
    assert Encoder(BYTES).ids(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(libraries, counter, text):
    assert counter.count(text) == len(libraries[1].encode(text, add_special_tokens=False).ids)
    assert Encoder(BYTES).ids(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "!", "'s", " ", "<|endoftext|>", "<|", "Don't", "été", "日本", "\n", "thntshansh"]), max_size=12).map("".join))
def test_stored_totals_are_the_counts(libraries, counter, text):
    exact = len(libraries[1].encode(text, add_special_tokens=False).ids)
    stored, table = counter.running(text), counter.prefixes(text)
    assert counter.count(text) == stored.total() == table.total() == exact
    assert stored.text == table.text
    for budget in range(-1, exact + 2):
        assert stored.longest_within(budget) == table.longest_within(budget)


@pytest.mark.parametrize("text", ["Don't they're there, 'll 'rest of", "héllo wörld thntshansh idiotic 123", "a!<|endoftext|>b <|endoftext|><|startoftext|> x<|end"])
def test_every_prefix(libraries, counter, text):
    found = counter.prefixes(text)
    exact = [len(libraries[1].encode(found.text[:k], add_special_tokens=False).ids) for k in range(len(found.text) + 1)]
    assert found.counts.tolist() == exact and found.total() == counter.count(text)
    for budget in range(max(exact) + 2):
        assert len(found.longest_within(budget)) == max(k for k, n in enumerate(exact) if n <= budget)


def test_token_counts_query(spark, libraries):
    docs = documents(spark)
    found = token_counts(docs.select("*", F.lit(1).alias("n_tokens")), WORDS, limit=100).collect()
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), len(libraries[1].encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)
    texts, counter = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}, PrefixCounter(WORDS)
    assert any(r.over_limit for r in found)
    assert all(r.fitting_chars == len(counter.prefixes(texts[r.doc_id]).longest_within(100)) for r in found if r.doc_id is not None)
    assert token_counts(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_closest_multiset_is_best(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    chosen = closest_multiset(counts, room)
    assert sum(k * v for k, v in chosen.items()) == max(sums) and all(v <= counts[k] for k, v in chosen.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 200), max_size=20))
def test_plans_place_every_item_once(counts):
    plan = minimum_bin_slack(counts, 64)
    lengths = np.array([k for k, v in counts.items() for _ in range(v)], np.int64)
    ranks = np.array([i for v in counts.values() for i in range(v)], np.int64)
    pieces = place(plan.arrays(), lengths, ranks)
    assert pieces.groupby("item")["length"].sum().reindex(range(len(lengths)), fill_value=0).tolist() == lengths.tolist()
    filled = pieces.groupby("sequence")["length"].sum()
    assert (filled < 64).sum() <= 1 and (filled <= 64).all() and len(filled) == plan.sequences
    for _, g in pieces.sort_values("offset").groupby("sequence"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]


@pytest.mark.parametrize("texts", [None, ["same text " * 12] * 300])
def test_packing(spark, libraries, texts):
    docs = documents(spark) if texts is None else spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = pack(docs.select("*", F.lit(0).alias("item")), BYTES, capacity=64).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.append(np.array(libraries[0].encode(r.text or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4"))
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for i, v in ids.items():
        if len(v) == 1:
            mine = sorted((r.start, r.length) for r in rows if r.doc_id == i)
            assert [s for s, _ in mine] == np.cumsum([0, *[n for _, n in mine]])[:-1].tolist()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    full = 0
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        full += sum(n for _, n in parts) == 64
    assert full >= len(by_sequence) - 1
    assert pack(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<[]>/INSTs ab", max_size=30), st.text(alphabet="\\<[]>/INSTs ab", max_size=8))
def test_escapes_are_reversible(text, role):
    assert unescape(escape(text)) == text
    assert not any(x in escape(text) for x in ("[INST]", "[/INST]", "</s>"))
    assert parse(f"[INST]{escape(role)}[/INST]{escape(text)}</s>") == (role, text)


def test_chat_tree(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no </s>[INST] \\"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, None, None), (4, 0, None, None), (None, 5, "user", "a"), (None, None, "assistant", "b"), (5, 0, "user", "日本 " * 4000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, node string")
    nodes, places = chat_tree(df, BYTES)
    by_node = {(r.pack, r.node): r for r in nodes.collect()}
    assert len(by_node) <= len(turns)
    one_pack = chat_tree(df.where("conv_id < 4"), BYTES)
    if one_pack[0].select("pack").distinct().count() == 1:
        assert one_pack[0].count() == 4  # hi, yo, no, more
    for r in by_node.values():
        assert r.n_tokens == len(r.ids)
        path, up = [], by_node.get((r.pack, r.parent))
        while up is not None:
            path, up = [(up.begin, up.begin + up.n_tokens), *path], by_node.get((up.pack, up.parent))
        assert [x for a, b in path for x in range(a, b)] == [x for s in r.attends for x in range(s["begin"], s["end"])]
        assert r.position == sum(b - a for a, b in path)
    found = {r.conv_id: r for r in read_back(nodes, places, BYTES).collect()}
    convs = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] or 0, x[1] if x[1] is not None else -1)):
        convs[c].append((role or "", text or ""))
    assert set(found) == set(convs)
    for c, said in convs.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert found[c].n_turns == len(said)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(f"[INST]{escape(r)}[/INST]{escape(t)}</s>") for r, t in said)


def test_chat_tree_empty(spark):
    nodes, places = chat_tree(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"), BYTES)
    assert nodes.count() == 0 and read_back(nodes, places, BYTES).count() == 0


def test_chat_tree_shares_late_turns(spark):
    """Conversations share 40 turns, and 60 with every second one: what a kind shares is emitted once."""
    said = lambda c, t: "all" if t < 40 else f"kind {c % 2}" if t < 60 else f"own {c}"
    turns = [(c, t, "user", f"{said(c, t)} {t}") for c in range(12) for t in range(61)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        nodes, places = chat_tree(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), BYTES)
        assert nodes.select("pack").distinct().count() == 1
        assert nodes.count() == 40 + 2 * 20 + 12
        assert places.count() == len(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


BLANKS = [" " * 2_000_000, "\n" * 2_000_000 + "a", "\t" * 2_000_000 + " b", " " * 4999 + "x", "\n " * 30_000 + "."]


@pytest.mark.parametrize("text", BLANKS, ids=["spaces", "lines", "tabs", "short", "mixed"])
def test_ids_of_long_runs_of_blanks(libraries, text):
    assert Encoder(BYTES).ids(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_packing_and_chats_of_long_runs_of_blanks(spark, libraries):
    packed = pack(spark.createDataFrame([(1, BLANKS[0]), (2, BLANKS[1])], "doc_id bigint, text string"), BYTES).collect()
    total = {r.doc_id: r.doc_tokens for r in packed}
    assert total == {i: len(libraries[0].encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, BLANKS[0]), (2, BLANKS[1]))}
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in total} == total
    turns = spark.createDataFrame([(1, 0, "user", BLANKS[1]), (1, 1, "assistant", BLANKS[0])], "conv_id bigint, turn int, role string, text string")
    read = read_back(*chat_tree(turns, BYTES), BYTES).first()
    assert read.loss_chars == 2_000_000 and read.loss_sha256 == hashlib.sha256(BLANKS[0].encode()).hexdigest()


def test_turns_that_differ_by_where_a_nul_stands(spark):
    turns = [(1, 0, "a\0b", "c"), (2, 0, "a", "b\0c")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r.turns_sha256 for r in read_back(*chat_tree(df, BYTES), BYTES).collect()}
    assert found == {i: hashlib.sha256(f"{role}\n{text}\n".encode()).hexdigest() for i, _, role, text in turns}


def test_turns_are_shared_by_content_not_by_digest(spark, monkeypatch):
    from tidemark.llm import chat_tree as module
    from tidemark.llm.packing import Encoder

    monkeypatch.setattr(module, "_digest", lambda role, text: b"\0" * 32)  # every digest collides
    rows = [(0, "x", "user", "one"), (0, "y", "user", "two"), (0, "z", "user", "two")]
    nodes = [r for r in module._grow(Encoder(BYTES), iter(rows)) if r.get("ids") is not None]
    assert len(nodes) == 2


def test_long_words_are_counted_in_proportion(counter):
    import random
    import time

    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    began = time.perf_counter()
    stored = counter.running(word)
    cut = stored.longest_within(2048)
    assert time.perf_counter() - began < 30 and word.startswith(cut)  # quadratic work would take hours
    assert counter.prefixes(cut).total() <= 2048 < counter.prefixes(word[: len(cut) + 1]).total()
