"""The registered queries of the operators, as the contracts word them, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, conversation_repair, decontamination, hard_negatives, jaccard_join, language_id, line_dedup, pii, quality,
               quality_rules, suffix_dedup, topk)
from .common import hash_mod, id_key, small_batches

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d WHERE length(h) >= 100),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM w JOIN m USING (s) WHERE first < doc_id),
counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS runs
            FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS pos, h FROM d),
kept AS (SELECT b.doc_id, string_agg(substr(h, 2 * b.pos + 1, 2), '' ORDER BY b.pos) AS k
         FROM bytes b LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.pos = g.pos WHERE g.pos IS NULL GROUP BY b.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op1_suffix_dedup", _SUFFIX_SQL)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM shared UNION ALL SELECT y, x FROM shared),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(y) AS component_id
FROM s JOIN reach ON s.doc_id = reach.x GROUP BY s.doc_id, len(s)"""


@query("op2_jaccard_join", _JACCARD_SQL)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.i, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query("op3_line_dedup", _LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "lines.n_lines", "lines.n_dropped",
                       F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, hash_mod("doc_id", 3) != 1)
    made = language_id.identify(docs.select("doc_id", "text"), model)
    return made.select("doc_id", (hash_mod("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
_CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
         lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS span
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS span
  FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN windows v ON p.span = v.span AND p.n = v.n),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
counted AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op6_decontamination", _CONTAMINATION_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", *[pii.count_of(F.col("pii.base"), k).alias(f"n_{k}") for k in pii.KINDS],
                       F.sha2(pii.span_text(F.col("pii.base")).cast("binary"), 256).alias("base_sha256"),
                       pii.span_text(F.concat("pii.base", "pii.added")).alias("spans"))


_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op8_top_k", _TOP_K_SQL)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled().alias("vector"))
    return topk.exact_top_k(vectors, F.col("vec_id") % 100 == 0)


@query("op9_chat")
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                   "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select(*tricky.columns).unionByName(tricky)
    return chat.read_back(chat.format_conversations(conversations))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), hash_mod("doc_id", 5) != 0)
    made = quality.score_quality(docs, model)
    return made.select("doc_id", (hash_mod("doc_id", 5) == 0).alias("held_out"), "quality_score.*")


def damage(conversations: DataFrame) -> DataFrame:
    """Drops, empties, cuts, repeats or relabels rows by a hash of conversation and turn; nulls are one space."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    role = F.when(fate == 4, "user").otherwise(known("role"))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return (conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                 F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy")).drop("_copy"))


_REPAIR_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                   lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
                                 xor(crc, b)), 4294967295), 4294967295) % 20 AS fate
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed) WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' END AS fault
  FROM placed),
paired AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM paired GROUP BY conv_id),
moves(q, r, cost, letters, said) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edits(q, initial, r, cost, letter, role) AS (VALUES
  (0, 's', 1, 0, 'K', NULL), (0, 'u', 2, 0, 'K', NULL), (1, 'u', 2, 0, 'K', NULL), (2, 'a', 3, 0, 'K', NULL),
  (3, 'u', 2, 0, 'K', NULL), (0, NULL, 2, 2, 'R', 'user'), (1, NULL, 2, 2, 'R', 'user'), (2, NULL, 3, 2, 'R', 'assistant'),
  (3, NULL, 2, 2, 'R', 'user'), (0, NULL, 0, 3, 'D', NULL), (1, NULL, 1, 3, 'D', NULL), (2, NULL, 2, 3, 'D', NULL),
  (3, NULL, 3, 3, 'D', NULL)),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM counted
  UNION ALL
  SELECT conv_id, i + 1, r, min(way) FROM (
    SELECT p.conv_id, p.i, e.r, {
      'cost': p.best.cost + m.cost + e.cost + CASE WHEN j.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END,
      'audit': p.best.audit || m.letters || e.letter,
      'said': list_concat(list_concat(p.best.said, m.said),
        CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.role, j.role) || ':' || j.text] END)} AS way
    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
      JOIN moves m ON m.q = p.q
      JOIN edits e ON e.q = m.r AND (e.initial IS NULL OR e.initial = j.initial)
    WHERE e.letter = 'D' OR j.fault IS NULL OR j.fault = 'truncated') GROUP BY conv_id, i, r),
ended AS (
  SELECT p.conv_id, min({'cost': p.best.cost + m.cost, 'audit': p.best.audit || m.letters,
                         'said': list_concat(p.best.said, m.said)}) AS best
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
    JOIN moves m ON m.q = p.q AND m.r IN (0, 3) GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op12_conversation_repair", _REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(damage(conversations))
    counts, digests = repaired.report(), repaired.digests()
    key = id_key("conv_id").alias("key")
    counts = counts.select(key, *counts.columns[1:])
    digests = digests.select(key, *digests.columns[1:])
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns[1:]]
    return (conversations.select("conv_id", key).distinct().join(counts, "key", "left").join(digests, "key", "left")
            .select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


_BLANK = r"\x20\x09-\x0D"
_RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[{_BLANK}]+'), lambda w: w <> '') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
twice AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^{_BLANK}]')
          GROUP BY doc_id),
windows AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS said
  FROM d, (VALUES (4), (8), (33)) sizes(k) WHERE len(w) >= k),
repeated AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, said) AS n FROM windows) WHERE n > 1),
places AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS place FROM repeated),
found AS (SELECT doc_id, count(*) FILTER (WHERE k = 8) AS n_repeat_words, count(*) FILTER (WHERE k = 4) AS n_covered,
            count(*) FILTER (WHERE k = 33) AS long FROM places GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(long, 0) AS long
  FROM d LEFT JOIN twice USING (doc_id) LEFT JOIN found USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_covered <= 30 * n_words AND long = 0 AS kept
FROM counted"""


@query("op13_quality_rules", _RULES_SQL)
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", quality_rules.rules("text").alias("rules"))
    return made.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                          "base_failed", "kept")])


_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), topk.scaled(scale=256).alias("vector"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)
