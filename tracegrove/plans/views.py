"""Stand-in tables built from the driver's star schema, in Spark and as DuckDB SQL.

The two forms are written independently of each other: the SQL of a view is what the oracle
of a query starts from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import tokens as K
from ..session import tune

ORDER = ["row_no", "row_sub"]


@dataclass(frozen=True)
class Query:
    """A registered query: the Spark side and, where SQL can say it, the oracle."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


# Row keys used to spread a table that arrives as one small file.
SPREAD_KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"],
    "orders": ["o_orderkey"],
    "documents": ["doc_id"],
    "events": ["event_id"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One that comes as fewer splits than there are cores is spread by its
    row key, so that per-row work uses all of them; a large table is left as it is read."""
    df = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, *SPREAD_KEYS[name])
    return df


# --- SQL pieces ------------------------------------------------------------------------------

BOX_SQL = r"'\\boxed\{([^}]*)(?:\}|$)'"


def extract_sql(text: str) -> str:
    boxes = f"list_transform(regexp_extract_all({text}, {BOX_SQL}, 1), lambda x: trim(x))"
    return f"coalesce(list_filter({boxes}, lambda x: x <> '')[-1], '')"


def number_sql(c: str) -> str:
    form = r"'[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?|[+-]?(?i:inf|infinity|nan)'"
    return f"CASE WHEN regexp_full_match({c}, {form}) THEN try_cast(replace({c}, '_', '') AS DOUBLE) END"


def match_sql(stored: str, pred: str, mode: str = A.ASYMMETRIC, binary: bool = True) -> str:
    s, p = f"trim(coalesce({stored}, ''))", f"trim(coalesce({pred}, ''))"
    sn, pn = f"({number_sql(s)})", f"({number_sql(p)})"
    if mode == A.ASYMMETRIC:
        close = f"CASE WHEN {sn} = 0 THEN abs({pn}) < 0.01 ELSE abs({sn} - {pn}) / abs({sn}) <= 0.01 END"
    else:
        close = (
            f"({sn} = {pn} OR (NOT isinf({sn}) AND NOT isinf({pn}) AND "
            f"abs({sn} - {pn}) <= greatest(0.01 * greatest(abs({sn}), abs({pn})), 0.00001)))"
        )
    guarded = f"(NOT isnan({sn}) AND NOT isnan({pn}) AND {close})"
    graded = f"CASE WHEN {sn} IS NOT NULL AND {pn} IS NOT NULL THEN {guarded} ELSE lower({s}) = lower({p}) END"
    if binary:
        graded = f"CASE WHEN regexp_full_match({s}, '[01]+') THEN lower({s}) = lower({p}) ELSE {graded} END"
    return f"({graded})"


HAS_BOX_SQL = "(position(chr(92) || 'boxed{' IN text) > 0)"

# --- views as SQL ----------------------------------------------------------------------------

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, body: str, *needs: str) -> None:
    SQL_VIEWS[name] = (needs, body)


def with_views(names: Iterable[str], query: str) -> str:
    """SQL text of a query with the views it names (and those they need) as CTEs."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        needs, body = SQL_VIEWS[name]
        for n in needs:
            add(n)
        seen[name] = body

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({b})" for n, b in seen.items())
    return f"WITH {ctes}\n{query}" if ctes else query


_view(
    "problems_v",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS category,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS answer,
       CASE WHEN p_size <= 30 THEN 'rule_found' WHEN p_size <= 40 THEN 'hypothesis_formed'
            ELSE 'rule_unknown' END AS status
       FROM part""",
)
_view(
    "rollouts_v",
    r"""SELECT CAST(l_partkey AS VARCHAR) AS problem_id, p_type AS category, a AS answer,
       l_orderkey * 8 + l_linenumber AS row_no,
       l_suppkey * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS row_sub,
       CASE WHEN l_quantity > 25 THEN 'probe' ELSE 'targeted' END AS stage,
       CASE WHEN l_returnflag = 'A' THEN 'First \boxed{ } and so \boxed{' || a || '}'
            WHEN l_returnflag = 'N' AND l_linestatus = 'F'
                 THEN 'So \boxed{' || CAST(CAST(a AS BIGINT) + l_linenumber * 1000 AS VARCHAR) || '}'
            WHEN l_returnflag = 'N'
                 THEN 'Hence \boxed{' || CAST(CAST(a AS BIGINT) + l_linenumber * 300 AS VARCHAR)
            ELSE 'The final answer is: ' || a END AS text,
       l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax
       FROM lineitem JOIN (SELECT *, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS a FROM part)
         ON l_partkey = p_partkey""",
)
_view(
    "graded_v",
    f"""SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN extracted END AS pred,
       CASE WHEN {HAS_BOX_SQL} AND {match_sql('answer', 'extracted')} THEN 1.0 ELSE 0.0 END AS reward,
       [l_linenumber, CAST(l_quantity AS INTEGER), CAST(l_suppkey AS INTEGER),
        CAST(round(l_discount * 100) AS INTEGER)] AS completion_token_ids,
       list_transform(range(1 + l_partkey % 5), lambda x: CAST(7 AS INTEGER)) AS prompt_token_ids,
       exp(l_tax) AS ppl_approx
       FROM (SELECT *, {extract_sql('text')} AS extracted FROM rollouts_v)""",
    "rollouts_v",
)
_view(
    "corpus_v",
    """SELECT CAST(doc_id % 400 AS VARCHAR) AS problem_id, lang AS category, doc_id AS row_no,
       doc_id % 3 AS part_index, ['S_solver', 'R_rft', 'N_neg'][doc_id % 3 + 1] AS part,
       ['S', 'R', 'N'][doc_id % 3 + 1] AS source,
       string_split(text, ' ') AS tokens, len(string_split(text, ' ')) AS n_tokens,
       len(string_split(text, ' ')) // 2 AS n_masked, 1.0 AS weight, 1.0 AS sign, text
       FROM documents""",
)
_view(
    "log_v",
    """SELECT event_id AS row_no, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) // 3600000000 AS step,
       CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END AS epoch,
       CAST(user_id AS VARCHAR) || CASE WHEN event_id % 10 = 0 THEN '-aug' ELSE '' END AS problem_id,
       event_type AS category, -value / 100 AS min_logprob, round(value * 100) AS total_loss,
       1 + event_id % 50 AS num_loss_tokens
       FROM events""",
)
_view(
    "bit_examples_v",
    """SELECT CAST(o_custkey AS VARCHAR) AS problem_id, o_orderkey AS row_no, x, y,
       lpad(format('{:b}', x), 8, '0') AS input_value, lpad(format('{:b}', y), 8, '0') AS output_value
       FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN ((x * 2) % 256) + (x // 128) WHEN 1 THEN xor(x, 90)
                WHEN 2 THEN xor(x, (x * 2) % 256) ELSE xor(x, CAST(o_orderkey // 256 AS BIGINT) % 256) END AS y
             FROM (SELECT *, o_orderkey % 256 AS x FROM orders))""",
)
_view(
    "linear_examples_v",
    """SELECT CAST(l_partkey AS VARCHAR) AS problem_id,
       CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5' AS input_value, l_quantity + 0.5 AS x,
       CAST(round((l_quantity + 0.5) * (1 + l_partkey % 7) * 100) + l_linenumber AS BIGINT) AS out_cents,
       CAST(round((l_quantity + 0.5) * (1 + l_partkey % 7) * 100) + l_linenumber AS BIGINT) // 100 || '.' ||
       lpad(CAST((CAST(round((l_quantity + 0.5) * (1 + l_partkey % 7) * 100) + l_linenumber AS BIGINT) % 100) AS VARCHAR), 2, '0')
         AS output_value
       FROM lineitem""",
)
_view(
    "equations_v",
    """SELECT CAST(l_suppkey AS VARCHAR) AS problem_id, l_orderkey * 8 + l_linenumber AS row_no,
       CAST(CAST(l_quantity AS INTEGER) + 10 AS VARCHAR) AS a,
       CASE l_returnflag WHEN 'A' THEN '+' WHEN 'N' THEN '*' ELSE '/' END AS op,
       CAST(10 + l_partkey % 90 AS VARCHAR) AS b,
       CASE (l_suppkey + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) % 6
            WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) + 10 + 10 + l_partkey % 90 AS VARCHAR)
            WHEN 1 THEN CAST((CAST(l_quantity AS BIGINT) + 10) * (10 + l_partkey % 90) AS VARCHAR)
            WHEN 2 THEN CAST(10 + l_partkey % 90 AS VARCHAR) || CAST(CAST(l_quantity AS BIGINT) + 10 AS VARCHAR)
            WHEN 3 THEN CASE WHEN CAST(l_quantity AS BIGINT) + 10 < 10 + l_partkey % 90
                          THEN CAST(abs(CAST(l_quantity AS BIGINT) - l_partkey % 90) AS VARCHAR) || '-'
                          ELSE CAST(CAST(l_quantity AS BIGINT) - l_partkey % 90 AS VARCHAR) END
            WHEN 4 THEN reverse(CAST((CAST(l_quantity AS BIGINT) + 10) * (10 + l_partkey % 90) + 1 AS VARCHAR))
            ELSE CAST(l_orderkey % 97 AS VARCHAR) END AS output_value
       FROM lineitem""",
)
_view(
    "predictions_v",
    """SELECT CAST(l.doc_id AS VARCHAR) AS id, CASE WHEN l.quality = 1 THEN 'v1' ELSE 'v2' END AS run, lang AS category,
       CAST(n_chars AS VARCHAR) AS answer,
       CASE WHEN l.doc_id % 3 = 0 THEN CAST(n_chars AS VARCHAR) || '.0' WHEN l.doc_id % 3 = 1 THEN CAST(n_chars + 2 AS VARCHAR)
            ELSE 'none' END AS predicted, quality, toxic
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)
_view(
    "runs_v",
    """SELECT CAST(conv_id AS VARCHAR) AS id, 'run' || CAST(turn AS VARCHAR) AS run, role,
       len(string_split(text, ' ')) AS num_gen_tokens, conv_id % 3 = 0 OR (conv_id % 3 = 1 AND turn % 2 = 0) AS correct
       FROM conversations""",
)


# --- views in Spark --------------------------------------------------------------------------


def _answer() -> Column:
    return F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")


def problems_v(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    status = F.when(size <= 30, "rule_found").when(size <= 40, "hypothesis_formed").otherwise("rule_unknown")
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_type").alias("category"),
        _answer().alias("answer"),
        status.alias("status"),
    )


def rollouts_v(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), _answer().alias("answer"))
    joined = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    flag, a = F.col("l_returnflag"), F.col("answer")

    def off(step: int) -> Column:
        return (a.cast("bigint") + F.col("l_linenumber") * step).cast("string")

    text = (
        F.when(flag == "A", F.concat(F.lit("First \\boxed{ } and so \\boxed{"), a, F.lit("}")))
        .when((flag == "N") & (F.col("l_linestatus") == "F"), F.concat(F.lit("So \\boxed{"), off(1000), F.lit("}")))
        .when(flag == "N", F.concat(F.lit("Hence \\boxed{"), off(300)))
        .otherwise(F.concat(F.lit("The final answer is: "), a))
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return joined.select(
        F.col("l_partkey").cast("string").alias("problem_id"),
        "category",
        "answer",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
        (F.col("l_suppkey") * 16777216 + cents).alias("row_sub"),
        F.when(F.col("l_quantity") > 25, "probe").otherwise("targeted").alias("stage"),
        text.alias("text"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_tax",
    )


def graded_v(spark: SparkSession, sf: str) -> DataFrame:
    n_prompt = (F.lit(1) + F.col("l_partkey") % 5).cast("int")
    completion = F.array(
        F.col("l_linenumber"),
        F.col("l_quantity").cast("int"),
        F.col("l_suppkey").cast("int"),
        F.round(F.col("l_discount") * 100).cast("int"),
    )
    logp = F.concat(F.array_repeat(F.lit(0.0), n_prompt), F.array_repeat(-F.col("l_tax"), 4))
    mask = F.concat(K.fill(0, n_prompt), K.fill(1, F.lit(4)))
    rows = rollouts_v(spark, sf)
    return rows.select(
        *rows.columns,
        F.when(F.col("l_linenumber") % 2 == 1, A.extract_answer(F.col("text"))).alias("pred"),
        A.reward(F.col("text"), F.col("answer")).alias("reward"),
        completion.alias("completion_token_ids"),
        F.array_repeat(F.lit(7), n_prompt).alias("prompt_token_ids"),
        logp.alias("old_logp"),
        K.perplexity(logp, mask).alias("ppl_approx"),
    )


PARTS = ["S_solver", "R_rft", "N_neg"]


def corpus_v(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    tokens = F.split("text", " ")
    n = F.size(tokens)
    masked = F.floor(n / F.lit(2)).cast("int")
    part = F.get(F.array(*[F.lit(p) for p in PARTS]), (doc % 3).cast("int"))
    return table(spark, sf, "documents").select(
        (doc % 400).cast("string").alias("problem_id"),
        F.col("lang").alias("category"),
        doc.alias("row_no"),
        (doc % 3).alias("part_index"),
        part.alias("part"),
        F.substring_index(part, "_", 1).alias("source"),
        tokens.alias("tokens"),
        F.concat(K.fill(0, masked), K.fill(1, n - masked)).alias("mask"),
        F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("sign"),
        "text",
    )


def log_v(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = events.agg(F.min(micros)).scalar()
    event = F.col("event_id")
    return events.select(
        event.alias("row_no"),
        F.floor((micros - start) / F.lit(3_600_000_000)).alias("step"),
        F.when(event % 4 == 3, 1).otherwise(0).alias("epoch"),
        F.concat(F.col("user_id").cast("string"), F.when(event % 10 == 0, "-aug").otherwise("")).alias("problem_id"),
        F.col("event_type").alias("category"),
        (-F.col("value") / 100).alias("min_logprob"),
        F.round(F.col("value") * 100).alias("total_loss"),
        (event % 50 + 1).alias("num_loss_tokens"),
    )


def bit_examples_v(spark: SparkSession, sf: str) -> DataFrame:
    x, key = F.col("x"), F.col("o_custkey") % 4
    y = (
        F.when(key == 0, (x * 2) % 256 + F.floor(x / F.lit(128)))
        .when(key == 1, x.bitwiseXOR(F.lit(90)))
        .when(key == 2, x.bitwiseXOR((x * 2) % 256))
        .otherwise(x.bitwiseXOR(F.floor(F.col("o_orderkey") / F.lit(256)) % 256))
    )
    rows = table(spark, sf, "orders").withColumn("x", F.col("o_orderkey") % 256)
    return rows.select(
        F.col("o_custkey").cast("string").alias("problem_id"),
        F.col("o_orderkey").alias("row_no"),
        F.lpad(F.bin("x"), 8, "0").alias("input_value"),
        F.lpad(F.bin(y), 8, "0").alias("output_value"),
    )


def linear_examples_v(spark: SparkSession, sf: str) -> DataFrame:
    exact = (F.col("l_quantity") + 0.5) * (F.col("l_partkey") % 7 + 1) * 100
    cents = F.round(exact).cast("bigint") + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("problem_id"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5")).alias("input_value"),
        F.concat(
            F.floor(cents / F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
        ).alias("output_value"),
    )


def equations_v(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("l_quantity").cast("bigint") + 10
    b = F.col("l_partkey") % 90 + 10
    flag = F.col("l_returnflag")
    kind = F.pmod(F.col("l_suppkey") + F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2), F.lit(6))

    def text(c: Column) -> Column:
        return c.cast("string")

    out = (
        F.when(kind == 0, text(a + b))
        .when(kind == 1, text(a * b))
        .when(kind == 2, F.concat(text(b), text(a)))
        .when(kind == 3, F.when(a < b, F.concat(text(b - a), F.lit("-"))).otherwise(text(a - b)))
        .when(kind == 4, F.reverse(text(a * b + 1)))
        .otherwise(text(F.col("l_orderkey") % 97))
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("problem_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
        text(a).alias("a"),
        F.when(flag == "A", "+").when(flag == "N", "*").otherwise("/").alias("op"),
        text(b).alias("b"),
        out.alias("output_value"),
    )


def predictions_v(spark: SparkSession, sf: str) -> DataFrame:
    doc, n = F.col("doc_id"), F.col("n_chars")
    predicted = (
        F.when(doc % 3 == 0, F.concat(n.cast("string"), F.lit(".0")))
        .when(doc % 3 == 1, (n + 2).cast("string"))
        .otherwise("none")
    )
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        doc.cast("string").alias("id"),
        F.when(F.col("quality") == 1, "v1").otherwise("v2").alias("run"),
        F.col("lang").alias("category"),
        n.cast("string").alias("answer"),
        predicted.alias("predicted"),
        "quality",
        "toxic",
    )


def runs_v(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        conv.cast("string").alias("id"),
        F.concat(F.lit("run"), turn.cast("string")).alias("run"),
        "role",
        F.size(F.split("text", " ")).cast("bigint").alias("num_gen_tokens"),
        ((conv % 3 == 0) | ((conv % 3 == 1) & (turn % 2 == 0))).alias("correct"),
    )
