"""Chat formatting by prefix trees: tokens that conversations share at their start are emitted once.

A turn is formatted as ``[INST]role[/INST]text</s>`` with role and text escaped: a backslash follows each of their
backslashes, ``<`` and ``[``, so no control string can occur in them, and taking it away again is exact. Head, text and
end of a turn are tokenised apart, which gives the loss mask: the text tokens of assistant turns.

Conversations are sorted by the digests of their turns, so those that share initial turns are neighbours. Each range of
the order is a pack, one token sequence: its trees are walked depth-first and each node (a turn after certain earlier
turns) is emitted once, with

* ``begin`` and ``n_tokens``, its place in the pack,
* ``position``, the position id of its first token: the tokens of its ancestors,
* ``attends``, the intervals of the pack that hold its ancestors (adjoining ones are one); within itself it is causal.

The work streams turn by turn, holding the path of one conversation. Conversations equal in their turns are dealt by id
as well, so a first turn or whole conversation that a third of all share spans several packs; a prefix is emitted again
only where a range of the order ends.

Defined results: null texts and roles count as empty; turns are ordered by turn (null first), role, text, so ties and
repeated rows are turns of their own; a null conv_id is one conversation; turns of any length are tokenised whole, one at
a time; an empty table gives empty ones; other columns pass by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, skew_safe_join
from tidemark.llm.packing import Encoder, encoder

HEAD, NECK, END = "[INST]", "[/INST]", "</s>"
_OUT_ROWS = 2000
#: Bytes of order keys that a batch holds, beside its last.
_OUT_BYTES = 1 << 24
_ESCAPE, _ESCAPED = re.compile(r"[\\<\[]"), re.compile(r"([\\<\[])\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    neck = formatted.index(NECK)
    if not formatted.startswith(HEAD) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(formatted[len(HEAD) : neck]), unescape(formatted[neck + len(NECK) : -len(END)])


def _digest(role: str, text: str) -> bytes:
    """Of a turn; the role's length comes first, so no two turns are written alike."""
    said = role.encode()
    return hashlib.sha256(len(said).to_bytes(8, "little") + said + text.encode()).digest()


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation: its order key, the digests of all its turns. Turns come sorted by conversation."""
    found: list[tuple] = []
    name, n, head, held = None, 0, bytearray(), 0

    def done() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([{"name": a, "n_turns": b, "order": c} for a, b, c in found], schema=pa.schema([("name", pa.string()), ("n_turns", pa.int64()), ("order", pa.binary())]))
        found.clear()
        return out

    for row_name, role, text in _rows(batches, ["name", "role", "text"]):
        if row_name != name:
            if n:
                found.append((name, n, bytes(head)))
                held += len(head)
                if len(found) >= _OUT_ROWS or held >= _OUT_BYTES:
                    yield done()
                    held = 0
            name, n, head = row_name, 0, bytearray()
        head += _digest(role, text)[:8]
        n += 1
    if n:
        found.append((name, n, bytes(head)))
    yield done()


_TREE = pa.schema([
    ("pack", pa.int32()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()),
    ("position", pa.int64()), ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ("ids", pa.list_(pa.int32())), ("name", pa.string()), ("nth", pa.int64()),
])


def _grow(encode: Encoder, rows: Iterator[tuple]) -> Iterator[dict]:
    """Nodes in depth-first order, and a row for each turn of each conversation that names its node."""
    path: list[dict] = []  # of the conversation before, or of this one as far as it has come
    name, depth, sharing, nodes, end = None, 0, True, 0, 0
    for pack, row_name, role, text in rows:
        if row_name != name:
            name, depth, sharing = row_name, 0, True
        if not (sharing and depth < len(path) and path[depth]["said"] == (role, text)):
            if sharing:
                del path[depth:]
                sharing = False
            parts = [encode.ids(HEAD + escape(role) + NECK), encode.ids(escape(text)), encode.ids(END)]
            ids = np.concatenate(parts)
            up = path[-1] if path else {"node": -1, "tokens": 0, "spans": []}
            spans = [*up["spans"][:-1], (up["spans"][-1][0], end + len(ids))] if up["spans"] and up["spans"][-1][1] == end else [*up["spans"], (end, end + len(ids))]
            loss = (len(parts[0]), len(parts[0]) + len(parts[1])) if role == "assistant" else (0, 0)
            path.append({"said": (role, text), "node": nodes, "tokens": up["tokens"] + len(ids), "spans": spans})
            yield {"pack": pack, "node": nodes, "parent": up["node"], "depth": depth, "begin": end, "n_tokens": len(ids), "position": up["tokens"], "loss_begin": loss[0], "loss_end": loss[1], "attends": [{"begin": a, "end": b} for a, b in up["spans"]], "ids": ids.astype(np.int32)}
            nodes, end = nodes + 1, end + len(ids)
        yield {"pack": pack, "node": path[depth]["node"], "name": name, "nth": depth}
        depth += 1


def chat_tree(turns: DataFrame, tokenizer_path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, places): the emitted nodes, and for each conversation (conv_id, name) and turn ``nth`` its node."""
    named = F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("null"))
    rows = turns.select(named.alias("name"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartition("name").sortWithinPartitions("name", "turn", "role", "text")
    keys = materialise(ordered.mapInArrow(_keys, "name string, n_turns bigint, order binary"), "chat-keys")
    n_rows = keys.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    # Turns carry the place of their conversation, not its key, which is as long as the conversation.
    sorted_keys = keys.repartitionByRange("order", "name").sortWithinPartitions("order", "name")
    ranks = materialise(sorted_keys.select("name", "n_turns", F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    keyed = skew_safe_join(rows, ranks, "name", n_rows, "n_turns")
    packs = keyed.repartitionByRange("rank").sortWithinPartitions("rank", "turn", "role", "text")
    packs = packs.select(F.spark_partition_id().alias("pack"), "name", "role", "text")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _grow(encoder(tokenizer_path), _rows(batches, ["pack", "name", "role", "text"])):
            held.append(row)
            if len(held) >= _OUT_ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=_TREE)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=_TREE)

    kind = "pack int, node bigint, parent bigint, depth bigint, begin bigint, n_tokens bigint, position bigint, loss_begin bigint, loss_end bigint, attends array<struct<begin:bigint,end:bigint>>, ids array<int>, name string, nth bigint"
    tree = materialise(packs.mapInArrow(grow, kind), "chat-tree")
    nodes = tree.where("name IS NULL").drop("name", "nth")
    kind = dict(turns.dtypes)[conv_id]
    back = F.when(F.col("name") != "null", F.substring(F.col("name"), 2, 1 << 30)).cast(kind)
    return nodes, tree.where("name IS NOT NULL").select(back.alias("conv_id"), "name", "nth", "pack", "node")


def read_back(nodes: DataFrame, places: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation, made from the emitted tokens: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    key = F.concat_ws(":", "pack", "node")
    uses = places.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("uses"))
    emitted = nodes.select(key.alias("key"), "ids", "loss_begin", "loss_end").join(uses, "key")
    joined = skew_safe_join(places.select("conv_id", "name", "nth", key.alias("key")), emitted, "key", places.count(), "uses")
    ordered = joined.select("conv_id", "name", "nth", "ids", "loss_begin", "loss_end").repartition("name").sortWithinPartitions("name", "nth")
    out = pa.schema([("name", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(tokenizer_path).fast.decode
        now, held = None, []

        def closed() -> dict:
            return {"name": now["name"], "n_turns": now["n"], "turns_sha256": now["turns"].hexdigest(), "loss_chars": now["loss_chars"], "loss_sha256": now["loss"].hexdigest(), "formatted_chars": now["chars"]}

        for name, ids, begin, end in _rows(batches, ["name", "ids", "loss_begin", "loss_end"]):
            if now is None or now["name"] != name:
                if now:
                    held.append(closed())
                    if len(held) >= _OUT_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=out)
                        held = []
                now = {"name": name, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            formatted = decode(ids)
            said = parse(formatted)
            now["n"] += 1
            now["chars"] += len(formatted)
            now["turns"].update(f"{said[0]}\n{said[1]}\n".encode())
            if end > begin:
                masked = unescape(decode(ids[begin:end]))
                now["loss_chars"] += len(masked)
                now["loss"].update(masked.encode())
        if now:
            held.append(closed())
        yield pa.RecordBatch.from_pylist(held, schema=out)

    kind = "name string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    found = ordered.mapInArrow(read, kind)
    back = F.when(F.col("name") != "null", F.substring(F.col("name"), 2, 1 << 30)).cast(dict(places.dtypes)["conv_id"])
    return found.select(back.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
