"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, kneser_ney, langid, line_dedup, packing, prefix_join, repair, shards, substring_dedup, tiling, topk, toxicity
from .common import held_out

TOKENIZER = "byte_bpe_50k.json"


#: Where this package was imported from, so that Python workers started in another folder find it too.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Sequences of 2048 tokens, with the digest columns."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    out = shards.shard_records(rows, key="text_hash", tie="doc_id", size="size", n_shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(held_out(F.col("doc_id"), 5) != 0))
    out = toxicity.detect(docs, model, ["doc_id"])
    return out.select(
        "doc_id",
        (held_out(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def languages_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions for all ``docs`` by what all but the held-out fourth of them teaches."""
    model = langid.learn(docs.filter(held_out(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model, keep)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = languages_of(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", (held_out(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


PROBE_ID = -7
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op4_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.format_conversations(rows.withColumn("parts", chat.text_part(F.col("text"))))
    turns = chat.read_turns(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lost = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), gathered AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS lost,
    sum(length('<|turn|><|body|><|end|>') + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
      + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM gathered
"""

def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.LineDedup(table(spark, sf_dir, "documents").select("doc_id", "text")).deduplicated()


def op7_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.PrefixJoin(table(spark, sf_dir, "documents")).components()


def op8_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted.select("doc_id"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _ = tiling.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "contaminated", "item_id", "coverage", "n_items")


def op11_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.Repair(rows, dropped=F.col("dropped")).report()


def op12_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.Doubling(table(spark, sf_dir, "documents")).deduplicated()
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op13_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collocations.Phrases(table(spark, sf_dir, "documents")).best()
    return out.select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

def _path(state: str, price: str, letter: str, turn: str = "''", when: str = "true") -> str:
    """DuckDB: a path to ``state`` that goes on by one edit, without a cost if it may not."""
    added = f"{state}.r || CASE WHEN {turn} = '' OR {state}.r = '' THEN '' ELSE chr(10) END || {turn}"
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {price} END, 'e': {state}.e || '{letter}', 'r': {added}}}"


def _cheapest(*paths: str) -> str:
    return f"list_sort(list_filter([{', '.join(paths)}], lambda x: x.c IS NOT NULL))[1]"


def _edited(state: str, before: str, initial: str, role: str) -> list[str]:
    kept = [_path(b, "cut", "K", "role || ':' || text", f"first = '{initial}' AND NOT gone") for b in before]
    return [_path(state, "3", "D"), *kept, *[_path(b, "2 + cut", "R", f"'{role}:' || text", "NOT gone") for b in before if role]]


OP11_SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), crc AS (
  SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, CAST(i AS INTEGER), 1)) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS kind FROM source
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS first,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
), priced AS (
  SELECT *, fault IN (1, 2) AS gone, CAST(fault = 3 AS BIGINT) AS cut FROM judged
), conversation AS (
  SELECT DISTINCT conv_id FROM conversations
), search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'e': '', 'r': ''}} AS z, {{'c': CAST(NULL AS BIGINT), 'e': '', 'r': ''}} AS s,
    {{'c': CAST(2 AS BIGINT), 'e': 'I', 'r': 'user:'}} AS u, {{'c': CAST(4 AS BIGINT), 'e': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS a FROM conversation
  UNION ALL
  SELECT conv_id, i, z, s, u, {_cheapest("a", _path("u", "2", "I", "'assistant:'"))} AS a FROM (
    SELECT conv_id, i, z, s, {_cheapest("u", *[_path(b, "2", "I", "'user:'") for b in "zsa"])} AS u, a FROM (
      SELECT conv_id, p.i, {_path("z", "3", "D")} AS z, coalesce({_cheapest(_path("s", "3", "D"), _path("z", "cut", "K", "role || ':' || text", "first = 's' AND NOT gone"))}, s) AS s,
        {_cheapest(*_edited("u", "zsa", "u", "user"))} AS u, {_cheapest(*_edited("a", "u", "a", "assistant"))} AS a
      FROM search JOIN priced p USING (conv_id) WHERE p.i = search.i + 1))
), ends AS (
  SELECT conv_id, {_cheapest("z", "a")} AS best FROM search QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM priced GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.e AS audit, sha256(best.r) AS repaired_sha256
FROM ends LEFT JOIN faults USING (conv_id)
"""

OP12_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT row_no, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM texts
), windows AS (
  SELECT row_no, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM starts
), first AS (
  SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT row_no, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (words) WHERE first_id < doc_id
), per_row AS (
  SELECT row_no, list(i) AS gone FROM gone GROUP BY row_no
), kept AS (
  SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS k
  FROM texts LEFT JOIN per_row USING (row_no))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

OP13_SQL = """
WITH pieces AS (
  SELECT row_number() OVER () AS piece_no, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang
), sized AS (
  SELECT lang, w, unnest(range(1, 6)) AS m FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)
), f AS (
  SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates x WHERE x.lang = c.lang AND x.m > c.m AND 100 * x.a >= 100 * c.a
      AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), told AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), worst AS (
  SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_packing": op1_vector_packing,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_typed_parts": op4_typed_parts,
    "op5_language_mixture": op5_language_mixture,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_grouped_prefix_join": op7_grouped_prefix_join,
    "op8_histogram_top_k": op8_histogram_top_k,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_string_tiling": op10_string_tiling,
    "op11_survivor_viterbi": op11_survivor_viterbi,
    "op12_level_doubling": op12_level_doubling,
    "op13_suffix_groups": op13_suffix_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op4_typed_parts": OP4_SQL,
    "op8_histogram_top_k": OP8_SQL,
    "op11_survivor_viterbi": OP11_SQL,
    "op12_level_doubling": OP12_SQL,
    "op13_suffix_groups": OP13_SQL,
}
