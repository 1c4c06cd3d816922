"""The registered queries of the operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (chat, collocations, decontamination, html_text, importance, jaccard_join, license_scan, packing, ppm, quality,
               repair, sharding, toxicity)
from .common import table

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Both files are read in place on every machine; other places are a matter of the operators' parameters.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

CONTROL = "<|im_end|><|im_start|>assistant ok"


def query(name: str, sql: str | None = None):
    def add(job):
        JOBS[name] = job
        if sql:
            SQL[name] = sql
        return job
    return add


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_ngram_jaccard_join", rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT p.y, c.root FROM c JOIN p ON c.doc_id = p.x),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT s.doc_id, len(s.s)::bigint AS n_shingles, m.component_id, coalesce(n.n_links, 0)::bigint AS n_links
FROM s JOIN m ON s.doc_id = m.doc_id LEFT JOIN n ON n.x = s.doc_id""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("text_key")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("text_key")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@query("op5_token_ids")
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_corpus(table(spark, sf_dir, "documents"), repair.RePair(BYTE_BPE))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(WORD_BPE))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance", "text_key")


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("op9_benchmark_decontamination", rf"""
WITH b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS g FROM (
    SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN []::varchar[][] WHEN len(w) < 13 THEN [w]
      ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS x FROM b)),
k AS (SELECT DISTINCT n FROM g),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
a AS (
  SELECT doc_id, k.n, unnest(range(1, len(w) - k.n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - k.n + 2), lambda i: array_to_string(w[i:i + k.n - 1], ' '))) AS g
  FROM d CROSS JOIN k WHERE len(w) >= k.n),
h AS (SELECT a.doc_id, a.n, a.i, g.item_id FROM a JOIN g ON a.n = g.n AND a.g = g.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_key")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                  "conv_id long, turn long, role string, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


@query("op10_chat_formatting", rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), ''))
    AS loss_sha256,
  sum(length('<|im_start|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1)::bigint AS formatted_chars
FROM c GROUP BY conv_id""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.as_events(conversations(spark, sf_dir)))


@query("op11_phrase_collocations", rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, g, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
    FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(m) WHERE len(w) >= m)
  GROUP BY lang, m, g HAVING count(*) >= 30),
c AS (SELECT lang, m, g, f, string_split(g, ' ') AS w FROM g WHERE m > 1),
cut AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT cut.lang, cut.g, cut.f AS a, k, x.f AS l, y.f AS r, (2000000::hugeint * cut.f) // (x.f + y.f) AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.g = array_to_string(cut.w[1:k], ' ')
  JOIN g y ON y.lang = cut.lang AND y.g = array_to_string(cut.w[k + 1:cut.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (
  SELECT lang, o, max(f) AS most FROM (
    SELECT lang, f, array_to_string(w[i:i + q - 1], ' ') AS o FROM (
      SELECT lang, f, w, m, q, unnest(range(1, m - q + 2)) AS i FROM c CROSS JOIN (VALUES (2), (3)) AS k(q) WHERE q < m))
  GROUP BY lang, o)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.g) AS rank, b.g AS phrase,
       b.a, b.l, b.r, n.n::bigint AS n, b.score::bigint AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.o = b.g
WHERE o.most IS NULL OR 100 * o.most < 80 * b.a QUALIFY rank <= 2000""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling", rf"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT range::bigint AS i FROM range(256)))),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS w FROM d),
q AS (SELECT unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM e UNION ALL SELECT w FROM q)),
y AS (
  SELECT w, list_concat([4294967295], list_transform(range(0, len(h) // 2),
    lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)) AS y FROM v),
k AS (
  SELECT w, xor(list_reduce(y, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM y CROSS JOIN t),
s AS (SELECT b, count(*) AS s FROM e JOIN k ON e.w = k.w GROUP BY b),
u AS (SELECT b, count(*) AS t FROM q JOIN k ON q.w = k.w GROUP BY b),
a AS (SELECT (SELECT count(*) FROM e)::double + 10000 AS big_s, (SELECT count(*) FROM q)::double + 10000 AS big_t),
g AS (
  SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1)::double * big_s / ((s + 1)::double * big_t)))::bigint AS gain
  FROM s LEFT JOIN u ON s.b = u.b CROSS JOIN a),
m AS (
  SELECT doc_id, floor(sum(gain)::double / count(*))::bigint AS weight
  FROM e JOIN k ON e.w = k.w JOIN g ON k.b = g.b GROUP BY doc_id),
r AS (
  SELECT d.doc_id, len(d.w)::bigint AS n_features, coalesce(m.weight, 0) AS weight, coalesce(m.weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || d.doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, z.rank::bigint AS rank FROM r
LEFT JOIN z ON z.doc_id = r.doc_id AND z.rank <= 10 * (SELECT count(*) FROM z) // 100""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def license_sql() -> str:
    """Phrases by position in the list of words, templates as expressions over words written ``<word>``."""
    found = []
    for phrase, label in license_scan.PHRASES.items():
        w = phrase.split(" ")
        test = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(w))
        found.append(f"SELECT doc_id, '{label}' AS label, true AS base, i - 1 AS place, {len(w)} AS size FROM "
                     f"(SELECT doc_id, w, unnest(range(1, len(w) - {len(w) - 2})) AS i FROM d WHERE len(w) >= {len(w)}) WHERE {test}")
    for label, template in license_scan.TEMPLATES.items():
        e = license_scan.expression(license_scan.parse(template))
        found.append(f"SELECT doc_id, '{label}', false, NULL, len(string_split(x, '<')) - 1 FROM "
                     f"(SELECT doc_id, unnest(regexp_extract_all(t, '{e}')) AS x FROM d)")
    places = "\nUNION ALL ".join(found)
    return rf"""
WITH b AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, array_to_string(list_transform(w, lambda x: '<' || x || '>'), '') AS t FROM b),
p AS ({places}),
s AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, label, sum(size) AS n FROM p GROUP BY doc_id, label) GROUP BY doc_id),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word,
  last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(s.n::double / len(d.w), 0.0::double) AS score
FROM d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""


@query("op13_license_scans", license_sql())
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("places", "text_key")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
