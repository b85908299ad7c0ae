"""Queries over single rows: extraction, grading, filters, text and token expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import hashing as H
from ..functions import text as X
from ..functions import tokens as K
from ..operators import mining, mixing, reports, rollouts, trainlog
from ..sources import tables as S
from . import views as V
from .views import ORDER, Query, extract_sql, match_sql, with_views

KEYS = ["problem_id", *ORDER]
KEYS_SQL = "problem_id, row_no, row_sub"
QUERIES: dict[str, Query] = {}


def add(name: str, run, views: list[str] | None = None, sql: str | None = None) -> None:
    QUERIES[name] = Query(run, None if sql is None else with_views(views or [], sql))


def joined(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


# --- answers ---------------------------------------------------------------------------------

add(
    "extract_answer",
    lambda s, d: V.rollouts_v(s, d).select(*KEYS, A.extract_answer(F.col("text")).alias("pred")),
    ["rollouts_v"],
    f"SELECT {KEYS_SQL}, {extract_sql('text')} AS pred FROM rollouts_v",
)


def _final_answer(spark, sf):
    boxed = V.rollouts_v(spark, sf).select(F.concat_ws(":", "row_no", "row_sub").alias("id"), "text")
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return boxed.unionByName(docs).select("id", A.extract_final_answer(F.col("text")).alias("final_answer"))


_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = rf"regexp_replace(%s, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_PHRASES = ", ".join(
    _STRIP % f"list_last(regexp_extract_all(text, '(?i){p}', 1))"
    for p in (
        r"The final answer is:\s*([^\n]+)",
        r"Final answer is:\s*([^\n]+)",
        r"Final answer\s*[:：]\s*([^\n]+)",
    )
)
_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
add(
    "extract_final_answer",
    _final_answer,
    ["rollouts_v"],
    f"""SELECT id, CASE WHEN regexp_matches(text, {V.BOX_SQL}) THEN {extract_sql('text')} ELSE
      coalesce({_PHRASES}, list_last(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')),
        list_last(list_filter(list_transform({_LINES}, lambda x: {_STRIP % 'x'}), lambda x: x <> '')), 'NOT_FOUND')
      END AS final_answer
      FROM (SELECT row_no || ':' || row_sub AS id, text FROM rollouts_v
            UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents)""",
)


def _graders(spark, sf):
    r = V.graded_v(spark, sf)
    stored, pred = F.col("answer"), A.extract_final_answer(F.col("text"))
    return r.select(
        *KEYS,
        A.answers_match(stored, pred).alias("asymmetric"),
        A.answers_match(stored, pred, mode=A.SYMMETRIC).alias("symmetric"),
        A.answers_match(stored, pred, mode=A.SYMMETRIC, binary_exact=False).alias("leaderboard"),
    )


_FINAL = f"coalesce(nullif({extract_sql('text')}, ''), regexp_extract(text, 'is: (.*)$', 1))"
add(
    "graders",
    _graders,
    ["rollouts_v"],
    f"""SELECT {KEYS_SQL}, {match_sql('answer', 'p')} AS asymmetric, {match_sql('answer', 'p', A.SYMMETRIC)} AS symmetric,
      {match_sql('answer', 'p', A.SYMMETRIC, False)} AS leaderboard
      FROM (SELECT *, {_FINAL} AS p FROM rollouts_v)""",
)


def _odd_pairs(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    n = (k % 50).cast("string")
    stored = F.when(k % 7 == 0, F.bin(k % 16)).when(k % 7 == 1, F.concat(F.lit("1_0"), n)).when(
        k % 7 == 2, F.lit("0.0")
    ).when(k % 7 == 3, F.concat(n, F.lit("d"))).when(k % 7 == 4, F.lit("inf")).otherwise(F.concat(F.lit(" "), n, F.lit(".50 ")))
    pred = F.when(k % 5 == 0, F.bin(k % 17)).when(k % 5 == 1, F.concat(F.lit("10"), n)).when(
        k % 5 == 2, F.lit("0.009")
    ).when(k % 5 == 3, F.concat(n, F.lit("D"))).otherwise(F.when(k % 3 == 0, "inf").otherwise(F.concat(n, F.lit(".501"))))
    return o.select("o_orderkey", stored.alias("stored"), pred.alias("pred")).select(
        "o_orderkey",
        A.answers_match(F.col("stored"), F.col("pred")).alias("asymmetric"),
        A.answers_match(F.col("stored"), F.col("pred"), mode=A.SYMMETRIC).alias("symmetric"),
        A.answers_match(F.col("stored"), F.col("pred"), mode=A.SYMMETRIC, binary_exact=False).alias("leaderboard"),
    )


add(
    "graders_odd_numbers",
    _odd_pairs,
    [],
    f"""SELECT o_orderkey, {match_sql('stored', 'pred')} AS asymmetric, {match_sql('stored', 'pred', A.SYMMETRIC)} AS symmetric,
      {match_sql('stored', 'pred', A.SYMMETRIC, False)} AS leaderboard FROM (
      SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN format('{{:b}}', o_orderkey % 16) WHEN 1 THEN '1_0' || n WHEN 2 THEN '0.0'
        WHEN 3 THEN n || 'd' WHEN 4 THEN 'inf' ELSE ' ' || n || '.50 ' END AS stored,
      CASE o_orderkey % 5 WHEN 0 THEN format('{{:b}}', o_orderkey % 17) WHEN 1 THEN '10' || n WHEN 2 THEN '0.009'
        WHEN 3 THEN n || 'D' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'inf' ELSE n || '.501' END END AS pred
      FROM (SELECT o_orderkey, CAST(o_orderkey % 50 AS VARCHAR) AS n FROM orders))""",
)

add(
    "reward",
    lambda s, d: V.graded_v(s, d).select(*KEYS, A.has_box(F.col("text")).alias("boxed"), "reward"),
    ["graded_v"],
    f"SELECT {KEYS_SQL}, {V.HAS_BOX_SQL} AS boxed, reward FROM graded_v",
)


def _correctness(spark, sf):
    r = V.graded_v(spark, sf)
    c = [F.col(x) for x in ("reward", "text", "answer", "pred")]
    return r.select(
        *KEYS,
        A.strictly_correct(*c).alias("strict"),
        A.leniently_correct(*c).alias("lenient"),
        A.wrong_attempt(*c, need_answer=True).alias("wrong"),
    )


_PRED = "coalesce(nullif(pred, ''), extracted)"
add(
    "correctness_flags",
    _correctness,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, {V.HAS_BOX_SQL} AND reward > 0 AND {match_sql('answer', _PRED)} AS strict,
      reward > 0 OR (text <> '' AND answer <> '' AND {V.HAS_BOX_SQL} AND {match_sql('answer', _PRED)}) AS lenient,
      reward <= 0 AND answer <> '' AND NOT {match_sql('answer', _PRED)} AS wrong FROM graded_v""",
)

# --- filters ---------------------------------------------------------------------------------

add(
    "category_allowlist",
    lambda s, d: mining.in_categories(V.graded_v(s, d), "ECONOMY, PROMO").select(*KEYS, "category"),
    ["rollouts_v"],
    f"SELECT {KEYS_SQL}, category FROM rollouts_v WHERE category IN ('ECONOMY', 'PROMO')",
)
_RULES = ["S_solver:fr,de", "N:en"]
_RULE_SQL = "((part = 'S_solver' AND category IN ('fr', 'de')) OR (source = 'N' AND category = 'en'))"
_CORPUS_OUT = ["problem_id", "row_no", "part_index", "category"]
add(
    "drop_rules",
    lambda s, d: V.corpus_v(s, d).filter(~mixing.dropped_category(_RULES)).select(*_CORPUS_OUT),
    ["corpus_v"],
    f"SELECT problem_id, row_no, part_index, category FROM corpus_v WHERE NOT {_RULE_SQL}",
)


def _rule_table(spark, sf):
    langs = V.table(spark, sf, "documents").select(F.col("lang").alias("category")).distinct()
    rules = langs.filter(F.col("category") != "en").select(F.lit("S_solver").alias("rule_part"), "category")
    return mixing.drop_categories(V.corpus_v(spark, sf), rules).select(*_CORPUS_OUT)


add(
    "drop_rules_by_table",
    _rule_table,
    ["corpus_v"],
    "SELECT problem_id, row_no, part_index, category FROM corpus_v WHERE NOT (part = 'S_solver' AND category <> 'en')",
)
add(
    "stage_filter",
    lambda s, d: V.rollouts_v(s, d).filter(F.col("stage") == "probe").groupBy("category").agg(F.count("*").alias("n")),
    ["rollouts_v"],
    "SELECT category, count(*) AS n FROM rollouts_v WHERE stage = 'probe' GROUP BY category",
)


def _verified_rollouts(spark, sf):
    found = V.problems_v(spark, sf).filter(F.col("status") == "rule_found").select(F.col("id").alias("problem_id"))
    return V.rollouts_v(spark, sf).join(found, "problem_id", "left_semi").select(*KEYS)


add(
    "status_filter",
    _verified_rollouts,
    ["rollouts_v", "problems_v"],
    f"SELECT {KEYS_SQL} FROM rollouts_v WHERE problem_id IN (SELECT id FROM problems_v WHERE status = 'rule_found')",
)
add(
    "head_limit",
    lambda s, d: V.rollouts_v(s, d).orderBy(*ORDER).limit(500).select(*KEYS),
    ["rollouts_v"],
    f"SELECT {KEYS_SQL} FROM rollouts_v ORDER BY row_no, row_sub LIMIT 500",
)
add(
    "completion_length_filter",
    lambda s, d: V.corpus_v(s, d)
    .withColumn("trained", K.trained_count(F.col("mask")))
    .filter(F.col("trained") <= 120)
    .select("row_no", "trained"),
    ["corpus_v"],
    "SELECT row_no, n_tokens - n_masked AS trained FROM corpus_v WHERE n_tokens - n_masked <= 120",
)


def _box_end(spark, sf):
    text = X.completion_text(F.col("text"), F.col("answer"))
    rows = V.rollouts_v(spark, sf).withColumn("decoded", F.when(F.col("l_suppkey") % 4 == 0, F.col("text")).otherwise(text))
    return rows.filter(A.valid_box_and_end(F.col("decoded"))).select(*KEYS)


add(
    "box_and_end_filter",
    _box_end,
    ["rollouts_v"],
    f"SELECT {KEYS_SQL} FROM rollouts_v WHERE l_suppkey % 4 <> 0",
)


def _trained_only(spark, sf):
    rows = V.corpus_v(spark, sf).withColumn("mask", F.transform("mask", lambda m: m * (F.col("row_no") % 2).cast("tinyint")))
    return rows.filter(K.has_trained_token(F.col("mask"))).select("row_no")


add("trained_token_filter", _trained_only, ["corpus_v"], "SELECT row_no FROM corpus_v WHERE row_no % 2 = 1")

# --- log-probabilities -----------------------------------------------------------------------


def _perplexity(spark, sf):
    steps = F.transform("completion_token_ids", lambda t, i: -F.col("l_tax") * (i + 1))
    n = F.size("prompt_token_ids")
    logp = F.concat(F.array_repeat(F.lit(0.0), n), steps)
    mask = F.concat(K.fill(0, n), F.transform("completion_token_ids", lambda t, i: (i >= F.col("l_linenumber") - 4).cast("tinyint")))
    return V.graded_v(spark, sf).select(*KEYS, F.round(K.perplexity(logp, mask), 6).alias("ppl"))


add(
    "perplexity",
    _perplexity,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, round(coalesce(exp(l_tax * list_avg(list_filter([1, 2, 3, 4], lambda i: i - 1 >= l_linenumber - 4))),
      'inf'::DOUBLE), 6) AS ppl FROM graded_v""",
)


def _sampled(spark, sf):
    ids = F.col("completion_token_ids")
    few = F.create_map(F.get(ids, F.lit(0)).cast("string"), -F.col("l_tax"))
    own = F.get(ids, F.lit(2)).cast("string")
    # A map has a key once: beside token 1000 the other candidate is the next one.
    other = F.when(own == "1000", "1001").otherwise("1000")
    many = F.map_concat(F.create_map(other, F.lit(-9.0)), F.create_map(own, -F.col("l_discount")))
    maps = F.when(F.col("l_linenumber") == 7, F.create_map().cast("map<string,double>")).when(F.col("l_linenumber") < 4, few).otherwise(many)
    token = F.when(F.col("l_linenumber") == 6, F.lit(77777777)).otherwise(F.get(ids, F.lit(2)))
    return V.graded_v(spark, sf).select(*KEYS, K.sampled_logprob(maps, token).alias("logprob"))


add(
    "sampled_logprob",
    _sampled,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, CASE WHEN l_linenumber < 4 THEN -l_tax WHEN l_linenumber IN (6, 7) THEN 0.0
      WHEN l_suppkey = 1000 THEN -l_discount ELSE -l_discount END AS logprob FROM graded_v""",
)
add(
    "mean_old_logp",
    lambda s, d: V.graded_v(s, d).select(
        *KEYS,
        F.round(K.mean_old_logp(F.col("old_logp")), 6).alias("mean_logp"),
        F.round(K.mean_old_logp_scalar(-F.col("l_tax"), F.col("completion_token_ids")), 6).alias("scalar_logp"),
    ),
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, round(-4 * l_tax / (4 + len(prompt_token_ids)), 6) AS mean_logp,
      round(-l_tax / 4, 6) AS scalar_logp FROM graded_v""",
)


def _divergence(spark, sf):
    text = F.col("text")
    other = F.split(F.replace(text, F.lit("en"), F.concat(F.lit("e"), F.lit("m"))), " ")
    rows = V.table(spark, sf, "documents").select("doc_id", K.first_divergence(F.split(text, " "), other).alias("d"))
    return rows.withColumn("bucket", K.divergence_bucket(F.col("d")))


add(
    "first_divergence",
    _divergence,
    [],
    """SELECT doc_id, d, CASE WHEN d < 128 THEN '0000-0127' WHEN d < 512 THEN '0128-0511' WHEN d < 1024 THEN '0512-1023'
      WHEN d < 2048 THEN '1024-2047' WHEN d < 4096 THEN '2048-4095' ELSE '4096+' END AS bucket FROM (
      SELECT doc_id, coalesce(list_position(list_transform(string_split(text, ' '),
        lambda w: position('en' IN w) > 0), true) - 1, len(string_split(text, ' '))) AS d FROM documents)""",
)

# --- texts -----------------------------------------------------------------------------------


def _cut(spark, sf):
    text = F.concat("text", F.lit(" done \n</think>\nafter \\boxed{1}"))
    return V.rollouts_v(spark, sf).select(*KEYS, A.cut_before_final_box(text).alias("attempt"))


add(
    "cut_before_final_box",
    _cut,
    ["rollouts_v"],
    rf"""SELECT {KEYS_SQL}, CASE WHEN text LIKE 'First%' THEN 'First \boxed{{ }} and so' WHEN text LIKE 'So%' THEN 'So'
      WHEN text LIKE 'Hence%' THEN 'Hence' ELSE text || ' done' END AS attempt FROM rollouts_v""",
)
add(
    "completion_text",
    lambda s, d: V.rollouts_v(s, d).select(
        *KEYS,
        X.completion_text(F.concat("text", F.lit("\n\n")), F.col("answer")).alias("completion"),
        X.completion_text(F.col("answer"), F.col("answer"), closing_box=False).alias("plain"),
    ),
    ["rollouts_v"],
    rf"""SELECT {KEYS_SQL}, (CASE WHEN text LIKE 'Hence%' THEN text ELSE text END) || chr(10) || '</think>' || chr(10) || '\boxed{{' ||
      coalesce(list_last(regexp_extract_all(text || chr(10) || chr(10), '\\boxed\{{([^}}]*)\}}', 1)), answer) || '}}<|im_end|>' AS completion,
      answer || chr(10) || '</think><|im_end|>' AS plain FROM rollouts_v""",
)
add(
    "chat_prompt",
    lambda s, d: V.table(s, d, "conversations").select(
        "conv_id", "turn", X.chat_prompt(F.col("text"), "<|im_start|>user\n{}<|im_end|>\n").alias("prompt")
    ),
    [],
    r"""SELECT conv_id, turn, '<|im_start|>user' || chr(10) || text || chr(10) ||
      'Please put your final answer inside `\boxed{}`. For example: `\boxed{your answer}`' || '<|im_end|>' || chr(10) AS prompt
      FROM conversations""",
)


def _detokenise(spark, sf):
    key = F.col("s_suppkey")
    piece = F.when(key % 10 == 3, "<0xC3><0xA9>").when(key % 10 == 4, "<0xE2>").otherwise(F.concat(F.col("s_name"), F.lit(" ")))
    vocab = V.table(spark, sf, "supplier").select(key.cast("int").alias("token_id"), piece.alias("token"))
    vocab = vocab.filter(F.col("token_id") % 10 != 5)
    rows = V.graded_v(spark, sf).select(*KEYS, "completion_token_ids")
    return S.detokenise(rows, "completion_token_ids", vocab, KEYS, name="decoded", keep_ids=False)


_PIECE = """CASE WHEN s.s_suppkey IS NULL OR s.s_suppkey % 10 = 5 THEN '<unk:' || t || '>' WHEN t % 10 = 3 THEN 'é'
  WHEN t % 10 = 4 THEN chr(65533) ELSE s_name || ' ' END"""
add(
    "detokenise",
    _detokenise,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, string_agg({_PIECE}, '' ORDER BY i) AS decoded
      FROM (SELECT {KEYS_SQL}, unnest(completion_token_ids) AS t, unnest([1, 2, 3, 4]) AS i FROM graded_v)
      LEFT JOIN supplier s ON t = s.s_suppkey GROUP BY {KEYS_SQL}""",
)
add(
    "split_tokenizer",
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.size(K.split_tokenizer(F.col("text"))).alias("n_tokens")),
    [],
    "SELECT doc_id, len(string_split(text, ' ')) AS n_tokens FROM documents",
)
add(
    "slug_and_wildcard",
    lambda s, d: V.table(s, d, "part").select(
        "p_partkey",
        X.slug(F.concat(F.lit("#"), "p_name", F.lit(" & "), "p_brand", F.lit("!"))).alias("slug"),
        X.wildcard(F.col("p_name"), "*ed w*t").alias("matches"),
    ),
    [],
    """SELECT p_partkey, lower(trim(regexp_replace('#' || p_name || ' & ' || p_brand || '!', '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug,
      regexp_full_match(p_name, '.*ed w.*t') AS matches FROM part""",
)


def _decimals(spark, sf):
    rows = V.linear_examples_v(spark, sf).select(
        "problem_id", F.col("output_value").alias("a"), F.concat("input_value", F.lit("1234")).alias("b")
    )
    left, right = X.align_decimals(F.col("a"), F.col("b"))
    return rows.select(
        "problem_id", "a", X.truncate_decimals(F.col("b")).alias("cut"), left.alias("padded"), right.alias("other")
    ).distinct()


add(
    "decimal_helpers",
    _decimals,
    ["linear_examples_v"],
    """SELECT DISTINCT problem_id, output_value AS a, input_value || '12' AS cut, output_value || '000' AS padded,
      input_value || '1234' AS other FROM linear_examples_v""",
)
add(
    "bracket_and_spell",
    lambda s, d: V.table(s, d, "part").select(
        "p_partkey",
        X.bracket_each(F.col("p_name")).alias("each"),
        X.bracket_whole(F.col("p_name")).alias("whole"),
        X.spell_out(F.col("p_name")).alias("spelled"),
        X.drop_leading_space(F.concat(F.lit("  "), "p_name")).alias("stripped"),
    ),
    [],
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: '【' || c || '】'), '') AS each,
      '【' || p_name || '】' AS whole, '–' || array_to_string(string_split(replace(p_name, ' ', ''), ''), '–') || '–' AS spelled,
      p_name AS stripped FROM part""",
)
add(
    "category_from_id",
    lambda s, d: V.table(s, d, "customer").select(
        "c_custkey",
        X.category_from_id(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("-"), "c_name")).otherwise(F.col("c_name"))).alias(
            "category"
        ),
    ),
    [],
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE left(c_name, 8) END AS category FROM customer",
)
add(
    "run_label",
    lambda s, d: V.table(s, d, "events").select("event_id", X.run_label(F.date_format("ts", "MM-dd-HH-mm-ss")).alias("label")),
    [],
    "SELECT event_id, strftime(ts, '%m/%d %H:%M') AS label FROM events",
)


def _equation(spark, sf):
    text = F.concat(F.col("l_suppkey").cast("string"), F.element_at(F.array(F.lit("+"), F.lit("-x"), F.lit("*")), F.col("l_linenumber") % 3 + 1), F.col("l_partkey").cast("string"))
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.parse_equation(text).alias("e"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e.a", "e.op", "e.b")


add(
    "parse_equation",
    _equation,
    [],
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 1 THEN CAST(l_suppkey AS VARCHAR) END AS a,
      CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 2 THEN '*' END AS op,
      CASE WHEN l_linenumber % 3 <> 1 THEN CAST(l_partkey AS VARCHAR) END AS b FROM lineitem""",
)
add(
    "to_roman",
    lambda s, d: V.table(s, d, "part").select("p_partkey", X.to_roman(F.col("p_partkey") % 4000).alias("roman")),
    [],
    """SELECT p_partkey, repeat('M', CAST(n // 1000 AS BIGINT)) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n % 1000 // 100 + 1]
      || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n % 100 // 10 + 1]
      || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman
      FROM (SELECT p_partkey, p_partkey % 4000 AS n FROM part)""",
)

# --- token arrays ----------------------------------------------------------------------------


def _make_example(spark, sf):
    tokens, mask = K.example(F.col("prompt_token_ids"), F.col("completion_token_ids"), limit=7)
    return V.graded_v(spark, sf).select(*KEYS, joined(tokens).alias("tokens"), joined(mask).alias("mask"))


add(
    "make_example",
    _make_example,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, array_to_string(list_concat(prompt_token_ids, completion_token_ids)[1:7], ' ') AS tokens,
      array_to_string(list_concat(list_transform(prompt_token_ids, lambda x: 0), [1, 1, 1, 1])[1:7], ' ') AS mask FROM graded_v""",
)
add(
    "keep_head_and_tail",
    lambda s, d: V.corpus_v(s, d).select(
        "row_no", F.array_join(K.keep_head_and_tail(F.col("tokens"), 200, 48), " ").alias("tokens")
    ),
    ["corpus_v"],
    """SELECT row_no, array_to_string(CASE WHEN n_tokens > 200 THEN list_concat(tokens[1:152], tokens[-48:]) ELSE tokens END, ' ')
      AS tokens FROM corpus_v""",
)


def _shift(spark, sf):
    tokens, mask = K.example(F.col("prompt_token_ids"), F.col("completion_token_ids"))
    inputs, targets, weights = K.shift_for_training(tokens, mask, F.lit(0.5), F.when(F.col("reward") > 0, 1.0).otherwise(-1.0))
    return V.graded_v(spark, sf).select(
        *KEYS, joined(inputs).alias("inputs"), joined(targets).alias("targets"), joined(F.transform(weights, lambda w: (w * 2).cast("int"))).alias("weights")
    )


add(
    "shift_for_training",
    _shift,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, array_to_string(t[:-2], ' ') AS inputs, array_to_string(t[2:], ' ') AS targets,
      array_to_string(list_transform(m[2:], lambda x: CAST(x * CASE WHEN reward > 0 THEN 1 ELSE -1 END AS INTEGER)), ' ') AS weights
      FROM (SELECT *, list_concat(prompt_token_ids, completion_token_ids) AS t,
      list_concat(list_transform(prompt_token_ids, lambda x: 0), [1, 1, 1, 1]) AS m FROM graded_v)""",
)


def _token_masks(spark, sf):
    """Corpus rows whose mask changes several times: words that start with a vowel are trained."""
    rows = V.corpus_v(spark, sf)
    return rows.withColumn("mask", F.transform("tokens", lambda t: t.rlike("^[aeiouAEIOU]").cast("tinyint")))


def _segments(spark, sf):
    rows = _token_masks(spark, sf).select(F.col("row_no").cast("string").alias("problem_id"), "tokens", "mask")
    seg = S.segments_of(rows)
    return seg.select("problem_id", "pos", "type", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


_SEGMENT_SQL = """SELECT row_no, min(i) AS pos, m, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS words FROM (
  SELECT row_no, i, t, m, sum(CASE WHEN m = p THEN 0 ELSE 1 END) OVER (PARTITION BY row_no ORDER BY i) AS g FROM (
  SELECT row_no, i, t, m, lag(m) OVER (PARTITION BY row_no ORDER BY i) AS p FROM (
  SELECT row_no, i, t, regexp_matches(t, '^[aeiouAEIOU]') AS m FROM (
  SELECT row_no, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM corpus_v)))) GROUP BY row_no, g, m"""
add(
    "segments",
    _segments,
    ["corpus_v"],
    f"""SELECT CAST(row_no AS VARCHAR) AS problem_id, pos, CASE WHEN m THEN 'unmasked' ELSE 'masked' END AS type, n,
      md5(words) AS digest FROM ({_SEGMENT_SQL})""",
)


def _segments_back(spark, sf):
    rows = _token_masks(spark, sf).select(
        F.col("row_no").cast("string").alias("problem_id"), "category", F.lit("").alias("answer"), "tokens", "mask"
    )
    back = S.rows_from_segments(S.segments_of(rows), reports.corpus_index(rows))
    return back.select(
        "problem_id",
        F.md5(F.array_join("tokens", " ")).alias("digest"),
        F.size("tokens").alias("n_tokens"),
        K.trained_count(F.col("mask")).alias("trained"),
    )


add(
    "rows_from_segments",
    _segments_back,
    ["corpus_v"],
    """SELECT CAST(row_no AS VARCHAR) AS problem_id, md5(text) AS digest, n_tokens,
      len(list_filter(tokens, lambda t: regexp_matches(t, '^[aeiouAEIOU]'))) AS trained FROM corpus_v""",
)


def _answer_span(spark, sf):
    text = F.when(
        F.col("l_linenumber") < 3, F.concat("text", F.lit(" steps </think> so \\boxed{"), "answer", F.lit("} end of turn"))
    ).otherwise(F.col("text"))
    rows = V.rollouts_v(spark, sf).select(*KEYS, text.alias("text"))
    pieces = F.split("text", " ")
    weights = F.transform(pieces, lambda p, i: F.when(i % 5 == 0, F.lit(0.25)).when(i % 5 == 1, F.lit(0.0)).otherwise(F.lit(1.0)))
    up = K.weight_answer_span(weights, K.char_offsets(pieces), F.col("text"))
    return rows.select(*KEYS, joined(F.transform(up, lambda w: (w * 100).cast("int"))).alias("weights"))


_SPAN_SQL = r"""SELECT *, string_split(t, ' ') AS w, len(t) - position('{dexob\' IN reverse(t)) - 6 AS box,
  position('{dexob\' IN reverse(t)) > 0 AS has FROM (SELECT *, CASE WHEN l_linenumber < 3 THEN
  text || ' steps </think> so \boxed{' || answer || '} end of turn' ELSE text END AS t FROM rollouts_v)"""
add(
    "answer_span_weights",
    _answer_span,
    ["rollouts_v"],
    rf"""SELECT {KEYS_SQL}, array_to_string(list_transform(w, lambda x, i: CAST(100 * CASE WHEN has AND i >= f AND i <= e AND base(i) > 0
      THEN greatest(1.0, 2 * base(i)) ELSE base(i) END AS INTEGER)), ' ') AS weights FROM x""".replace(
        "base(i)", "(CASE (i - 1) % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.0 ELSE 1.0 END)"
    ).replace(
        "FROM x",
        rf"""FROM (SELECT *, list_min(list_filter(range(1, len(w) + 1), lambda i: ends[i] > lo AND ends[i] - len(w[i]) < hi)) AS f,
        list_max(list_filter(range(1, len(w) + 1), lambda i: ends[i] > lo AND ends[i] - len(w[i]) < hi)) AS e FROM (
        SELECT *, list_transform(range(1, len(w) + 1), lambda i: len(array_to_string(w[1:i], ' '))) AS ends,
        CASE WHEN l_linenumber < 3 THEN position('</think>' IN t) - 1 ELSE box END AS lo,
        CASE WHEN position('}}' IN substr(t, box + 1)) > 0 THEN box + position('}}' IN substr(t, box + 1)) ELSE len(t) END AS hi
        FROM ({_SPAN_SQL})))""",
    ),
)

# --- hashes ----------------------------------------------------------------------------------

add(
    "stable_hashes",
    lambda s, d: V.table(s, d, "customer").select(
        "c_custkey",
        H.unit_interval(F.col("c_name")).alias("unit"),
        H.sha_mod(F.col("c_name"), 100).alias("mod100"),
        H.sha_mod(F.col("c_name"), 7).alias("mod7"),
        H.short_id(F.col("c_mktsegment"), F.col("c_custkey")).alias("short_id"),
    ),
    [],
    """SELECT c_custkey, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS unit,
      list_reduce(list_transform(range(64), lambda i: CAST(strpos('0123456789abcdef', h[i + 1]) - 1 AS BIGINT)),
        lambda a, b: (a * 16 + b) % 100) AS mod100,
      list_reduce(list_transform(range(64), lambda i: CAST(strpos('0123456789abcdef', h[i + 1]) - 1 AS BIGINT)),
        lambda a, b: (a * 16 + b) % 7) % 7 AS mod7,
      substr(sha256(c_mktsegment || '_' || c_custkey), 1, 8) AS short_id FROM (SELECT *, sha256(c_name) AS h FROM customer)""",
)

# --- logged rows -----------------------------------------------------------------------------


def logged_v(spark, sf) -> DataFrame:
    """Rollouts with two log-probability lists over their completion."""
    rows = V.graded_v(spark, sf)
    epoch = F.transform("completion_token_ids", lambda t, i: -F.col("l_tax") * (i + 1))
    ref = F.transform("completion_token_ids", lambda t, i: -F.col("l_discount") * (F.lit(4) - i) / 2)
    mask = F.transform("completion_token_ids", lambda t, i: (i + F.col("l_linenumber") >= 4).cast("tinyint"))
    return rows.select(*KEYS, "category", "reward", "l_linenumber", epoch.alias("epoch_lp"), ref.alias("ref_lp"), mask.alias("target_mask"))


V._view(
    "logged_v",
    """SELECT problem_id, row_no, row_sub, category, reward, l_linenumber, i, -l_tax * (i + 1) AS e, -l_discount * (4 - i) / 2 AS r,
       i + l_linenumber >= 4 AS m FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM graded_v)""",
    "graded_v",
)

add(
    "log_record",
    lambda s, d: trainlog.log_record(
        logged_v(s, d).withColumnRenamed("epoch_lp", "logprobs").withColumnRenamed("target_mask", "mask")
    ).select(*KEYS, "num_loss_tokens", "total_loss", "min_logprob"),
    ["logged_v"],
    f"""SELECT {KEYS_SQL}, count(*) FILTER (m) AS num_loss_tokens, round(coalesce(-sum(e) FILTER (m), 0), 4) AS total_loss,
      round(coalesce(min(e) FILTER (m), 0), 4) AS min_logprob FROM logged_v GROUP BY ALL""",
)


_NAMES = [
    "logprob_decreased", "logprob_increased", "branch_mask_fraction", "avg_branch_weight", "weighted_logprob_decreased",
    "weighted_logprob_increased", "cutoff_avg_weight", "avg_weight", "kl_per_token", "mean_importance_ratio",
    "clip_fraction_low", "clip_fraction_high", "dro_penalty_per_token", "nll",
]


def _comparison(spark, sf):
    return trainlog.comparison_metrics(logged_v(spark, sf), branch=0.05, cutoff=0.5).select(*KEYS, *_NAMES)


COMPARISON_SQL = f"""SELECT {KEYS_SQL}, round((count(*) FILTER (m AND e < r) + 0.5 * count(*) FILTER (m AND e = r)) / n, 6) AS logprob_decreased,
  round((count(*) FILTER (m AND e > r) + 0.5 * count(*) FILTER (m AND e = r)) / n, 6) AS logprob_increased,
  round(count(*) FILTER (m AND abs(e) <= 0.05) / n, 6) AS branch_mask_fraction,
  round(sum(w) FILTER (m) / n, 6) AS avg_branch_weight,
  round((coalesce(sum(w) FILTER (m AND e < r), 0) + 0.5 * coalesce(sum(w) FILTER (m AND e = r), 0)) / nullif(sum(w) FILTER (m), 0), 6) AS weighted_logprob_decreased,
  round((coalesce(sum(w) FILTER (m AND e > r), 0) + 0.5 * coalesce(sum(w) FILTER (m AND e = r), 0)) / nullif(sum(w) FILTER (m), 0), 6) AS weighted_logprob_increased,
  CASE WHEN n > 0 THEN 0.5 END AS cutoff_avg_weight,
  round(sum(w * 0.5) FILTER (m) / n, 6) AS avg_weight,
  round(sum(e - r) FILTER (m) / n, 6) AS kl_per_token,
  round(sum(exp(e - r)) FILTER (m) / n, 6) AS mean_importance_ratio,
  round(count(*) FILTER (m AND exp(e - r) < 0.8) / n, 6) AS clip_fraction_low,
  round(count(*) FILTER (m AND exp(e - r) > 1.2) / n, 6) AS clip_fraction_high,
  round(0.025 * sum((e - r) * (e - r)) / 4, 6) AS dro_penalty_per_token,
  round(-sum(e) FILTER (m) / n, 6) AS nll
  FROM (SELECT *, least(1.0, abs(e) / 0.05) AS w, CAST(nullif(count(*) FILTER (m) OVER (PARTITION BY problem_id, row_no, row_sub), 0) AS DOUBLE) AS n FROM logged_v)
  GROUP BY problem_id, row_no, row_sub, n"""
add("comparison_metrics", _comparison, ["logged_v"], COMPARISON_SQL)


def _preference_margin(spark, sf):
    rows = logged_v(spark, sf)
    chosen = K.mean_trained_logp(F.col("epoch_lp"), F.col("target_mask"))
    rejected = K.mean_trained_logp(F.col("ref_lp"), F.col("target_mask"))
    return rows.select(*KEYS, F.round(K.preference_loss(chosen, rejected), 6).alias("loss"))


add(
    "preference_margin",
    _preference_margin,
    ["logged_v"],
    f"""SELECT {KEYS_SQL}, round(ln(1 + exp(-(2 * (a - b) - 0.5))), 6) AS loss FROM (SELECT {KEYS_SQL},
      coalesce(avg(e) FILTER (m), 0) AS a, coalesce(avg(r) FILTER (m), 0) AS b FROM logged_v GROUP BY ALL)""",
)


def _sequence_ratio(spark, sf):
    objective = K.sequence_ratio_objective(
        F.col("epoch_lp"), F.col("ref_lp"), F.col("target_mask"), F.col("reward") * 2 - 1, eps_low=0.03, eps_high=0.04
    )
    return logged_v(spark, sf).select(*KEYS, F.round(objective, 6).alias("objective"))


add(
    "sequence_ratio",
    _sequence_ratio,
    ["logged_v"],
    f"""SELECT {KEYS_SQL}, round(least(c * (2 * reward - 1), least(greatest(c, 0.97), 1.04) * (2 * reward - 1)), 6) AS objective
      FROM (SELECT {KEYS_SQL}, reward, exp(coalesce(avg(e - r) FILTER (m), 0)) AS c FROM logged_v GROUP BY ALL)""",
)


def _aligned_old_logp(spark, sf):
    tokens = F.concat("prompt_token_ids", "completion_token_ids")
    old = F.when(F.col("l_linenumber") < 4, F.col("old_logp")).otherwise(F.slice("old_logp", 2, 100))
    rows = V.graded_v(spark, sf).select(*KEYS, K.align_old_logp(old, tokens).alias("x"))
    return rows.select(*KEYS, F.size("x").alias("n"), F.round(K.array_sum(F.col("x")), 6).alias("total"))


add(
    "align_old_logp",
    _aligned_old_logp,
    ["graded_v"],
    f"SELECT {KEYS_SQL}, len(prompt_token_ids) + 3 AS n, round(-4 * l_tax, 6) AS total FROM graded_v",
)


def _raw_tokens(spark, sf):
    token = F.transform(
        F.concat("prompt_token_ids", "completion_token_ids"),
        lambda t, i: F.struct(
            t.alias("token_id"),
            F.when(i == 0, F.lit(None)).when(i < F.size("prompt_token_ids"), -1.0).otherwise(-F.col("l_tax") * i).cast("double").alias("logprob"),
        ),
    )
    rows = V.graded_v(spark, sf).select(*KEYS, token.alias("t"))
    prompt, made = trainlog.split_raw_tokens(F.col("t"), -1.0)
    return rows.select(
        *KEYS,
        joined(prompt).alias("prompt_ids"),
        joined(made).alias("generated_ids"),
        F.round(trainlog.average_generated_logprob(F.col("t")), 6).alias("avg_logprob"),
    )


add(
    "raw_token_split",
    _raw_tokens,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, array_to_string(prompt_token_ids, ' ') AS prompt_ids, array_to_string(completion_token_ids, ' ') AS generated_ids,
      round(-l_tax * (len(prompt_token_ids) + 1.5), 6) AS avg_logprob FROM graded_v""",
)


def _min_of_maps(spark, sf):
    maps = F.transform(
        "completion_token_ids",
        lambda t, i: F.create_map(F.lit("a"), -F.col("l_tax") * i, F.lit("b"), -F.col("l_discount") * (i - 1)),
    )
    few = F.when(F.col("l_linenumber") == 1, F.slice(maps, 1, 0)).otherwise(maps)
    return V.graded_v(spark, sf).select(*KEYS, F.round(trainlog.min_logprob_of_maps(few), 6).alias("min_logprob"))


add(
    "min_logprob_of_maps",
    _min_of_maps,
    ["graded_v"],
    f"""SELECT {KEYS_SQL}, CASE WHEN l_linenumber > 1 THEN round(least(-3 * l_tax, -2 * l_discount), 6) END AS min_logprob FROM graded_v""",
)


def _branch_weights(spark, sf):
    adv = F.array_repeat(F.col("reward") * 2 - 1, 4)
    scaled = trainlog.branch_cutoff_weights(adv, F.col("epoch_lp"), 0, branch=0.05)
    return logged_v(spark, sf).select(*KEYS, F.round(K.array_sum(scaled), 6).alias("total"))


add(
    "branch_cutoff_weights",
    _branch_weights,
    ["logged_v"],
    f"SELECT {KEYS_SQL}, round(sum((2 * reward - 1) * least(1.0, abs(e) / 0.05) * 0.5), 6) AS total FROM logged_v GROUP BY ALL",
)


def _records(spark, sf):
    """Generation outputs with two completions per line, graded."""
    base = V.rollouts_v(spark, sf)
    ids = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    maps = F.transform(ids, lambda t, i: F.create_map(t.cast("string"), -F.col("l_tax") * (i + 1)))
    one = F.struct(ids.alias("token_ids"), F.col("text").alias("text"), maps.alias("logprobs"))
    two = F.struct(ids.alias("token_ids"), F.concat(F.lit("\\boxed{"), "answer", F.lit("}")).alias("text"), F.slice(maps, 1, 1).alias("logprobs"))
    outputs = base.select(*KEYS, "category", "answer", F.array(F.lit(5), F.lit(6)).alias("prompt_token_ids"), F.array(one, two).alias("completions"))
    out = rollouts.records_from_outputs(outputs, "probe")
    return out.select(*KEYS, "sample_no", "pred", "reward", F.round("ppl_approx", 6).alias("ppl"), F.size("old_logp").alias("n_logp"), "stage")


add(
    "records_from_outputs",
    _records,
    ["rollouts_v"],
    rf"""SELECT {KEYS_SQL}, k AS sample_no, pred, CASE WHEN position(chr(92) || 'boxed{{' IN text) > 0 AND {match_sql('answer', 'pred')} THEN 1.0 ELSE 0.0 END AS reward,
      round(exp(l_tax * CASE WHEN k = 0 THEN 1.5 ELSE 0.5 END), 6) AS ppl, 4 AS n_logp, 'probe' AS stage FROM (
      SELECT *, {extract_sql('text')} AS pred FROM (
      SELECT {KEYS_SQL}, answer, l_tax, 0 AS k, text FROM rollouts_v
      UNION ALL SELECT {KEYS_SQL}, answer, l_tax, 1, '\boxed{{' || answer || '}}' FROM rollouts_v))""",
)
