"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat_tree import chat_tree, read_back
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.fuzzy_lines import fuzzy_lines
from tidemark.llm.language_id import fit_language_id, identify_language
from tidemark.llm.mixing import mix_sources
from tidemark.llm.multi_index import search
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack
from tidemark.llm.source_divergence import source_divergence
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.llm.whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).withColumnRenamed("text_digest", "text_sha256")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(_documents(spark, sf_dir))


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    vocabulary = _vocabulary("byte_bpe_50k.json")
    return read_back(*chat_tree(turns.unionByName(more), vocabulary), vocabulary)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return identify_language(docs, fit_language_id(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).drop("copies")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_multi_index": op1_multi_index,
        "op2_toxicity": op2_toxicity,
        "op3_pack": op3_pack,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_fuzzy_lines": op5_fuzzy_lines,
        "op6_chat_tree": op6_chat_tree,
        "op7_language_id": op7_language_id,
        "op8_token_counts": op8_token_counts,
        "op9_near_dedup": op9_near_dedup,
        "op10_mix_sources": op10_mix_sources,
        "op11_decontaminate": op11_decontaminate,
        "op12_whiten": op12_whiten,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(l)))::INT AS line_no, lower(trim(unnest(l), ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS line FROM cut),
firsts AS (
  SELECT line, min((doc_id, line_no)) AS first FROM lines WHERE line <> '' GROUP BY line),
classes AS (
  SELECT row_number() OVER (ORDER BY first) AS id, line, first FROM firsts),
grams AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, greatest(length(line) - 9, 1) + 1), lambda i: substr(line, i, 10))) AS s FROM classes),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
sized AS (SELECT * FROM grams JOIN sizes USING (id)),
pairs AS (
  SELECT a.id AS x, b.id AS y, count(*) AS shared, any_value(a.n) AS p, any_value(b.n) AS q
  FROM sized a JOIN sized b ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 75 * (p + q - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, other) AS (
  SELECT x, y FROM edges UNION SELECT r.id, e.y FROM reach r JOIN edges e ON r.other = e.x),
lowest AS (SELECT id, min(other) AS low FROM reach GROUP BY id),
best AS (
  SELECT c.line, d.first AS first FROM classes c LEFT JOIN lowest l USING (id) JOIN classes d ON d.id = least(c.id, coalesce(l.low, c.id)))
SELECT l.doc_id, l.line_no, coalesce(b.first[1], l.doc_id) AS component_doc_id, coalesce(b.first[2], l.line_no) AS component_line_no,
       b.first IS NULL OR (b.first[1] = l.doc_id AND b.first[2] = l.line_no) AS kept
FROM lines l LEFT JOIN best b USING (line)
"""

OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('[INST][/INST]</s>') + length(regexp_replace(role, '([\\<\[])', '\1\\', 'g')) + length(regexp_replace(text, '([\\<\[])', '\1\\', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT x, y FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
lowest AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sizes GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS fills_at,
         ((SELECT sum(size) FROM sizes) * 1.5::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WHERE source_size > 0),
chosen AS (SELECT arg_min(level, fills_at) FILTER (WHERE fills_at >= level) AS level FROM filled),
targets AS (
  SELECT s.source, s.source_size, least(s.weight * c.level, 2.0::DOUBLE * s.source_size) AS target FROM sources s, chosen c),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
parts AS (
  SELECT *, floor(rate) AS sure, rate - floor(rate) AS p, target - floor(rate) * source_size AS wanted FROM rates),
numbered AS (
  SELECT *, floor(1000.0::DOUBLE * size / (size + 100)) AS worth, row_number() OVER (PARTITION BY doc_id, size) AS nth FROM sizes),
worths AS (
  SELECT source, CASE WHEN sum(size) > 0 THEN sum((worth * size)::HUGEINT)::DOUBLE / sum(size)::DOUBLE ELSE 0 END AS mean_worth FROM numbered GROUP BY source),
ranked AS (
  SELECT d.*, t.source_size, t.target, t.sure, t.p AS part, t.wanted,
         t.p + least(t.p, 1 - t.p) * ((d.worth - w.mean_worth) / 1000.0::DOUBLE) AS p,
         (('0x' || substr(md5('mix-2|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || d.size || '|' || d.nth), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM numbered d JOIN parts t ON d.source IS NOT DISTINCT FROM t.source JOIN worths w ON d.source IS NOT DISTINCT FROM w.source),
ordered AS (
  SELECT *, CASE WHEN part > 0 THEN u / (1 - u) * ((1 - p) / p) END AS odds FROM ranked),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM ordered)
SELECT doc_id, size, source_size, target,
       ((sure + CASE WHEN part > 0 AND before + size / 2 <= wanted THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM running
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS said
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT uid, size, place, array_to_string(w[place:place + size - 1], ' ') AS said
  FROM (SELECT uid, w, size, unnest(range(1, len(w) - size + 2)) AS place FROM docs, sizes)),
met AS (SELECT uid, place, size, item FROM grams JOIN windows USING (size, said)),
hits AS (SELECT uid, count(DISTINCT word) AS n_hit FROM (SELECT uid, unnest(range(place, place + size)) AS word FROM met) GROUP BY uid),
held AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT uid, item FROM met) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (uid) LEFT JOIN held USING (uid)
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (SELECT uid, lang, source, term, count(*) AS n FROM (SELECT uid, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang),
cells AS (SELECT c.* FROM counted c JOIN kept USING (lang, term)),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN cells USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v.v) AS p
  FROM groups g JOIN v USING (lang) JOIN totals t USING (lang, source) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
of_lang AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q FROM kept k JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares JOIN of_lang USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op5_fuzzy_lines": OP5_SQL, "op6_chat_tree": OP6_SQL, "op9_near_dedup": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_decontaminate": OP11_SQL, "op13_source_divergence": OP13_SQL}
