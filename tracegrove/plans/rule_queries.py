"""Queries that infer rules from examples, and queries that generate problems from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import hashing as H
from ..functions import text as X
from ..operators import rules, synth
from . import views as V
from .rollout_queries import _PRED
from .row_queries import _SPACE
from .views import Query, match_sql, with_views

QUERIES: dict[str, Query] = {}


def add(name: str, run, views: list[str] | None = None, sql: str | None = None) -> None:
    QUERIES[name] = Query(run, None if sql is None else with_views(views or [], sql))


# --- linear rules ----------------------------------------------------------------------------


def _linear_questions(spark, sf):
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("problem_id"), F.concat(F.col("p_size").cast("string"), F.lit(".25")).alias("question")
    )


add(
    "solve_linear",
    lambda s, d: rules.solve_linear(V.linear_examples_v(s, d), _linear_questions(s, d)),
    ["linear_examples_v"],
    """SELECT problem_id, p_size || '.25' AS question, k / 1000.0::DOUBLE AS factor, (p_size * 100 + 25) * k // 100 / 1000.0::DOUBLE AS answer FROM (
      SELECT problem_id, quantile_disc(out_cents * 10 * 1000 // CAST(x * 1000 AS BIGINT), 0.5) AS k FROM linear_examples_v GROUP BY problem_id)
      JOIN part ON problem_id = CAST(p_partkey AS VARCHAR)""",
)
add(
    "solve_squared",
    lambda s, d: rules.solve_linear(V.linear_examples_v(s, d), _linear_questions(s, d), squared=True),
    ["linear_examples_v"],
    """SELECT problem_id, p_size || '.25' AS question, k / 1000.0::DOUBLE AS factor, (p_size * 100 + 25) * (p_size * 100 + 25) * k // 10000 / 1000.0::DOUBLE AS answer FROM (
      SELECT problem_id, quantile_disc(out_cents * 10 * 1000 // CAST(x * x * 1000 AS BIGINT), 0.5) AS k FROM linear_examples_v GROUP BY problem_id)
      JOIN part ON problem_id = CAST(p_partkey AS VARCHAR)""",
)

# --- substitution ----------------------------------------------------------------------------


def _shifted(text, by):
    """Text with every letter moved by a per-row number of places."""
    rotated = F.substring(F.lit(rules.ALPHABET * 2), by + 1, F.lit(26))
    return F.call_function("translate", text, F.lit(rules.ALPHABET), rotated)


def cipher_lines(spark, sf) -> DataFrame:
    """Lines of each document with their cipher text. Some lines gain a word, some change a
    letter, so that word counts differ and mappings contradict each other."""
    doc = F.col("doc_id")
    lines = V.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("row_no", "line"))
    cipher = _shifted(F.col("line"), (doc % 25 + 1).cast("int"))
    plain = F.when((doc + F.col("row_no")) % 5 == 4, F.concat("line", F.lit(" extra"))).when(
        F.col("row_no") > 1, F.replace("line", F.lit("e"), F.lit("o"))
    ).otherwise(F.col("line"))
    return lines.select(doc.cast("string").alias("problem_id"), "row_no", cipher.alias("input_value"), plain.alias("output_value"))


def _letters(df):
    entries = F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    return df.select("problem_id", F.array_join(entries, " ").alias("mapping"))


def _rotated_sql(text: str, by: str) -> str:
    return f"translate({text}, '{rules.ALPHABET}', substr('{rules.ALPHABET * 2}', CAST({by} + 1 AS BIGINT), 26))"


V._view(
    "cipher_v",
    f"""SELECT *, {_rotated_sql('line', 'doc_id % 25 + 1')} AS c, CASE WHEN row_no > 1 THEN replace(line, 'e', 'o') ELSE line END AS p FROM (
      SELECT doc_id, row_no, ls[row_no + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS row_no FROM (
        SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents)))
      WHERE (doc_id + row_no) % 5 <> 4""",
)
_PAIRS = f"""(SELECT doc_id, row_no, unnest(string_split(regexp_replace(c, '[{_SPACE}]+', '', 'g'), '')) AS k,
  unnest(string_split(regexp_replace(p, '[{_SPACE}]+', '', 'g'), '')) AS v FROM cipher_v)"""
add(
    "substitution_maps",
    lambda s, d: _letters(rules.substitution_maps(cipher_lines(s, d))),
    ["cipher_v"],
    f"""SELECT CAST(doc_id AS VARCHAR) AS problem_id, string_agg(k || '>' || v, ' ' ORDER BY k) AS mapping FROM (
      SELECT doc_id, k, arg_min(v, row_no) AS v FROM {_PAIRS} WHERE k <> '' GROUP BY doc_id, k) GROUP BY doc_id""",
)


def _translate(spark, sf):
    maps = rules.substitution_maps(cipher_lines(spark, sf))
    doc = F.col("doc_id")
    questions = V.table(spark, sf, "documents").select(
        doc.cast("string").alias("problem_id"), _shifted(F.lower(F.col("source")), (doc % 25 + 1).cast("int")).alias("question")
    )
    q = questions.join(maps, "problem_id")
    return q.select(
        "problem_id",
        rules.translate(F.col("question"), F.col("mapping")).alias("plain"),
        F.array_join(rules.unknown_letters(F.col("question"), F.col("mapping")), "").alias("unknown"),
        F.array_join(rules.unused_targets(F.col("mapping")), "").alias("unused"),
    )


add(
    "translate_cipher",
    _translate,
    ["cipher_v"],
    f"""SELECT CAST(d.doc_id AS VARCHAR) AS problem_id,
      array_to_string(list_transform(string_split(lower(source), ''), lambda x: CASE WHEN list_contains(ks, {_rotated_sql('x', 'd.doc_id % 25 + 1')}) THEN x ELSE '?' END), '') AS plain,
      coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(lower(source), ''), lambda x: {_rotated_sql('x', 'd.doc_id % 25 + 1')}),
        lambda x: NOT list_contains(ks, x)))), ''), '') AS unknown,
      array_to_string(list_filter(string_split('{rules.ALPHABET}', ''), lambda x: NOT list_contains(vs, x)), '') AS unused
      FROM documents d JOIN (SELECT doc_id, list(k) AS ks, list(v) AS vs FROM (
        SELECT doc_id, k, arg_min(v, row_no) AS v FROM {_PAIRS} WHERE k <> '' GROUP BY doc_id, k) GROUP BY doc_id) m ON d.doc_id = m.doc_id""",
)


def _decipher(spark, sf):
    key = F.col("p_partkey")
    part = V.table(spark, sf, "part")
    by = (key % 25 + 1).cast("int")
    plain = F.lower(F.col("p_type"))
    examples = part.select(key.cast("string").alias("problem_id"), F.lit(0).alias("row_no"), _shifted(plain, by).alias("input_value"), plain.alias("output_value"))
    questions = part.select(key.cast("string").alias("problem_id"), _shifted(F.col("p_name"), by).alias("question"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("word"))
    solved = rules.solve_cipher(questions, rules.substitution_maps(examples), words)
    return solved.select("problem_id", F.col("solution").alias("plain"))


_SHAPE = "list_transform(string_split({w}, ''), lambda x: position(x IN {w}))"
add(
    "decipher",
    _decipher,
    [],
    f"""WITH dict AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
    q AS (SELECT DISTINCT lower(p_type) AS t, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part),
    one AS (SELECT q.*, min(d.w) AS d1 FROM q LEFT JOIN dict d ON len(d.w) = len(w1) AND {_SHAPE.format(w='d.w')} = {_SHAPE.format(w='w1')}
      AND len(list_filter(range(1, len(w1) + 1), lambda i: CASE WHEN contains(t, w1[i]) THEN d.w[i] <> w1[i] ELSE contains(t, d.w[i]) END)) = 0 GROUP BY ALL),
    two AS (SELECT one.*, min(d.w) AS d2 FROM one LEFT JOIN dict d ON len(d.w) = len(w2) AND {_SHAPE.format(w='d.w')} = {_SHAPE.format(w='w2')}
      AND len(list_filter(range(1, len(w2) + 1), lambda i: CASE WHEN contains(t, w2[i]) THEN d.w[i] <> w2[i]
        WHEN contains(w1, w2[i]) THEN d.w[i] <> d1[position(w2[i] IN w1)] ELSE contains(t || d1, d.w[i]) END)) = 0 GROUP BY ALL)
    SELECT CAST(p_partkey AS VARCHAR) AS problem_id, d1 || ' ' || d2 AS plain FROM part JOIN two ON t = lower(p_type) AND p_name = w1 || ' ' || w2""",
)

# --- bit rules -------------------------------------------------------------------------------

_BITS = ", ".join(f"(x >> {7 - i}) & 1" for i in range(8))
_RULES_SQL = """(SELECT f, fam, i, j, row_number() OVER (ORDER BY f, i, j) AS prio FROM (
  SELECT unnest(range(10)) AS f, unnest(['I', 'NOT', '0', '1', 'XOR', 'OR', 'AND', 'AND-NOT', 'XOR-NOT', 'OR-NOT']) AS fam),
  range(8) a(i), range(8) b(j) WHERE CASE WHEN f < 2 THEN j = 0 WHEN f < 4 THEN i = 0 AND j = 0 ELSE i <> j END)"""
_VALUE_SQL = """CASE f WHEN 0 THEN p WHEN 1 THEN 1 - p WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN xor(p, s) WHEN 5 THEN p | s WHEN 6 THEN p & s
  WHEN 7 THEN p & (1 - s) WHEN 8 THEN xor(p, 1 - s) ELSE p | (1 - s) END"""
V._view(
    "vectors_v",
    f"""SELECT problem_id, bit, arg_min(fam, prio) AS fam, arg_min(f, prio) AS f, arg_min(i, prio) AS i, arg_min(j, prio) AS j FROM (
      SELECT problem_id, bit, prio, fam, f, i, j FROM (SELECT DISTINCT problem_id, x, y FROM bit_examples_v), range(8) k(bit), {_RULES_SQL},
        LATERAL (SELECT (x >> (7 - i)) & 1 AS p, (x >> (7 - j)) & 1 AS s)
      GROUP BY ALL HAVING bool_and(({_VALUE_SQL}) = ((y >> (7 - bit)) & 1))) GROUP BY problem_id, bit""",
    "bit_examples_v",
)
V._view(
    "solved_v",
    f"""SELECT problem_id, xq, string_agg(fam || CASE WHEN f IN (2, 3) THEN '' WHEN f < 2 THEN '' || i ELSE i || ',' || j END, ' ' ORDER BY bit) AS vector,
      string_agg(({_VALUE_SQL}), '' ORDER BY bit) AS solution, list(fam ORDER BY bit) AS fams, list(f ORDER BY bit) AS fs, list(i ORDER BY bit) AS is_, list(j ORDER BY bit) AS js
      FROM (SELECT *, (xq >> (7 - i)) & 1 AS p, (xq >> (7 - j)) & 1 AS s FROM (SELECT *, CAST(problem_id AS BIGINT) * 37 % 256 AS xq FROM vectors_v))
      GROUP BY problem_id, xq HAVING count(*) = 8""",
    "vectors_v",
)


def _bit_questions(spark, sf):
    key = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(key.cast("string").alias("problem_id"), F.lpad(F.bin(key * 37 % 256), 8, "0").alias("question"))


def _solved_bits(spark, sf):
    return rules.solve_bits(V.bit_examples_v(spark, sf), _bit_questions(spark, sf))


def _vector_text(vector):
    return F.array_join(
        F.transform(
            vector, lambda r: F.concat(r["family"], F.concat_ws(",", r["primary"].cast("string"), r["secondary"].cast("string")))
        ),
        " ",
    )


add(
    "solve_bits",
    lambda s, d: _solved_bits(s, d).select("problem_id", "question", _vector_text(F.col("vector")).alias("vector"), "solution"),
    ["solved_v"],
    "SELECT problem_id, lpad(format('{:b}', xq), 8, '0') AS question, vector, solution FROM solved_v",
)


def _weakness(spark, sf):
    return rules.weakness_counts(V.graded_v(spark, sf), rules.infer_bit_rules(V.bit_examples_v(spark, sf)))


_WRONG = f"reward <= 0 AND answer <> '' AND NOT {match_sql('answer', _PRED)}"
add(
    "weakness_counts",
    _weakness,
    ["solved_v", "graded_v"],
    f"""SELECT family, CAST(sum(n) AS BIGINT) AS wrong_rollouts FROM (SELECT problem_id, count(*) AS n FROM graded_v WHERE {_WRONG} GROUP BY problem_id)
      JOIN (SELECT DISTINCT problem_id, unnest(fams) AS family FROM solved_v) USING (problem_id) GROUP BY family""",
)


def _sections(spark, sf):
    key = F.col("problem_id").cast("bigint") % 4
    x = F.conv("question", 2, 10).cast("bigint")
    y = F.when(key == 0, (x * 2) % 256 + F.floor(x / F.lit(128))).when(key == 1, x.bitwiseXOR(F.lit(90))).otherwise(x.bitwiseXOR((x * 2) % 256))
    solved = _solved_bits(spark, sf).withColumn("answer", F.lpad(F.bin(y), 8, "0"))
    return rules.section_accuracy(solved).withColumn("accuracy", F.round("accuracy", 6))


_STEP = """fs[b] = fs[b + 1] AND (fs[b] IN (2, 3) OR ((is_[b] + 1) % 8 = is_[b + 1] AND (fs[b] < 2 OR (js[b] + 1) % 8 = js[b + 1])))"""
add(
    "section_accuracy",
    _sections,
    ["solved_v"],
    f"""SELECT sections, count(*) AS total, count(*) FILTER (ok) AS correct, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accuracy,
      coalesce(array_to_string(list_sort(list(problem_id ORDER BY problem_id) FILTER (ok))[1:3], ', '), '') AS correct_ids,
      coalesce(array_to_string(list_sort(list(problem_id ORDER BY problem_id) FILTER (NOT ok))[1:3], ', '), '') AS wrong_ids FROM (
      SELECT problem_id, 1 + len(list_filter(range(1, 8), lambda b: NOT ({_STEP.replace('fs[b] = fs[b + 1]', '(fs[b] = fs[b + 1] OR (fs[b] IN (2, 3) AND fs[b + 1] IN (2, 3)))')}))) AS sections,
        solution = lpad(format('{{:b}}', CASE CAST(problem_id AS BIGINT) % 4 WHEN 0 THEN ((xq * 2) % 256) + (xq // 128) WHEN 1 THEN xor(xq, 90) ELSE xor(xq, (xq * 2) % 256) END), 8, '0') AS ok
      FROM solved_v) GROUP BY sections""",
)

# --- numeric operations ----------------------------------------------------------------------

_T = "len(a) = 2 AND len(b) = 2"
_OPS_SQL = [
    "a || b", "b || a", "x + y", "abs(x - y)", "-abs(x - y)", "x - y", "y - x", "x * y", "x * y + 1", "x * y - 1", "x + y + 1", "x + y - 1", "x - y + 1", "x - y - 1",
    "CASE WHEN x <> 0 AND y <> 0 THEN greatest(x, y) % least(x, y) END", "CASE WHEN y <> 0 THEN x // y END", "CASE WHEN y <> 0 THEN x % y END",
    "CASE WHEN x <> 0 THEN y // x END", "CASE WHEN x <> 0 THEN y % x END",
    "abs(e - g) || '' || abs(f - h)", "(e + g) % 10 || '' || (f + h) % 10", "(e - g + 10) % 10 || '' || (f - h + 10) % 10", "e * g + f * h", "e * h + f * g",
    "e * g || '' || f * h", "e * h || '' || f * g", "(e + f) - (g + h)", "(e + f) + (g + h)", "e * f - g * h", "e * f + g * h", "e * h - f * g", "abs(e * h - f * g)",
]
_OP_NAMES = [
    "concatenation", "reverse concatenation", "addition", "absolute difference", "negated absolute difference", "subtraction (a-b)", "reverse subtraction (b-a)",
    "multiplication", "multiply+1", "multiply-1", "add+1", "add-1", "sub+1", "sub-1", "max mod min", "integer division (a/b)", "modulo (a mod b)",
    "reverse division (b/a)", "reverse modulo (b mod a)", "digit absolute diff", "digit add mod10", "digit sub mod10", "cross multiply", "cross multiply rev",
    "digit multiply", "digit multiply rev", "digit sum diff", "digit sum sum", "digit product diff", "digit product sum", "determinant", "abs determinant",
]


def _results_sql() -> str:
    items = [f"CASE WHEN {_T} THEN CAST({o} AS VARCHAR) END" if k >= 19 else f"CAST({o} AS VARCHAR)" for k, o in enumerate(_OPS_SQL)]
    return "[" + ", ".join(items) + "]"


def _digits_sql(source: str) -> str:
    return f"""(SELECT *, CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y, TRY_CAST(substr(a, 1, 1) AS INTEGER) AS e, TRY_CAST(substr(a, 2, 1) AS INTEGER) AS f,
      TRY_CAST(substr(b, 1, 1) AS INTEGER) AS g, TRY_CAST(substr(b, 2, 1) AS INTEGER) AS h FROM {source})"""


_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in _OP_NAMES) + "]"
V._view(
    "rule_trials_v",
    f"""SELECT problem_id, op, prio, any_value(k) AS k, any_value(rev_ops) AS rev_ops, any_value(rev_res) AS rev_res FROM (
      SELECT problem_id, op, k, rev_ops, rev_res, (CASE WHEN k <= 8 THEN 0 ELSE 1000 END) + m * 100 + k AS prio,
        coalesce(CASE WHEN rev_res THEN reverse(rs[k]) ELSE rs[k] END = o, false) AS hit FROM (
      SELECT problem_id, op, m, o, m IN (0, 2) AS rev_ops, m IN (0, 3) AS rev_res, unnest(range(1, 33)) AS k, rs FROM (
      SELECT problem_id, op, m, o, {_results_sql()} AS rs FROM {_digits_sql('''(SELECT problem_id, op, m, CASE WHEN m IN (0, 2) THEN reverse(a) ELSE a END AS a,
        CASE WHEN m IN (0, 2) THEN reverse(b) ELSE b END AS b,
        CASE WHEN op <> '-' AND suffixed AND output_value LIKE '%-' AND len(output_value) > 1 THEN '-' || left(output_value, -1) ELSE output_value END AS o
        FROM (SELECT *, bool_or(output_value LIKE '%-' AND len(output_value) > 1) OVER (PARTITION BY problem_id, op) AS suffixed FROM equations_v), range(4) t(m))''')})))
      GROUP BY problem_id, op, prio HAVING bool_and(hit)""",
    "equations_v",
)
V._view(
    "op_rules_v",
    f"""SELECT e.problem_id, e.op, n, first_row, suffixed, {_NAME_LIST}[k] AS rule_name, rev_ops, rev_res FROM (
      SELECT problem_id, op, count(*) AS n, min(row_no) AS first_row, bool_or(output_value LIKE '%-' AND len(output_value) > 1) AS suffixed FROM equations_v GROUP BY ALL) e
      LEFT JOIN (SELECT problem_id, op, arg_min(k, prio) AS k, arg_min(rev_ops, prio) AS rev_ops, arg_min(rev_res, prio) AS rev_res FROM rule_trials_v GROUP BY ALL) r
      ON e.problem_id = r.problem_id AND e.op = r.op""",
    "rule_trials_v",
)
add(
    "infer_numeric_ops",
    lambda s, d: rules.infer_numeric_ops(V.equations_v(s, d)),
    ["op_rules_v"],
    """SELECT problem_id, op, CASE WHEN suffixed THEN 'neg_suffix' ELSE 'num' END AS fmt, n AS examples, first_row, rule_name, rev_ops, rev_res FROM op_rules_v""",
)


def _equation_questions(spark, sf):
    k = F.col("s_suppkey")
    op = F.element_at(F.array(F.lit("+"), F.lit("*"), F.lit("/"), F.lit("%")), (k % 4 + 1).cast("int"))
    return V.table(spark, sf, "supplier").select(
        k.cast("string").alias("problem_id"), (k % 89 + 11).cast("string").alias("a"), op.alias("op"), (k * 7 % 89 + 11).cast("string").alias("b")
    )


_QUESTION_SQL = """(SELECT CAST(s_suppkey AS VARCHAR) AS problem_id, CAST(s_suppkey % 89 + 11 AS VARCHAR) AS a, ['+', '*', '/', '%'][s_suppkey % 4 + 1] AS op,
          CAST(s_suppkey * 7 % 89 + 11 AS VARCHAR) AS b FROM supplier)"""
add(
    "solve_equations",
    lambda s, d: rules.solve_equations(V.equations_v(s, d), _equation_questions(s, d)).select("problem_id", "op", "rule_name", "fmt", "solution"),
    ["op_rules_v"],
    f"""SELECT problem_id, op, rule_name, CASE WHEN suffixed THEN 'neg_suffix' ELSE 'num' END AS fmt,
      CASE WHEN suffixed AND starts_with(v, '-') THEN substr(v, 2) || op ELSE v END AS solution FROM (
      SELECT *, CASE WHEN rev_res THEN reverse(rs[list_position({_NAME_LIST}, rule_name)]) ELSE rs[list_position({_NAME_LIST}, rule_name)] END AS v FROM (
      SELECT *, {_results_sql()} AS rs FROM {_digits_sql(f'''(SELECT problem_id, op, rule_name, suffixed, rev_res, CASE WHEN rev_ops THEN reverse(a) ELSE a END AS a,
        CASE WHEN rev_ops THEN reverse(b) ELSE b END AS b FROM (
        SELECT q.problem_id, q.op, a, b, CASE WHEN o.op IS NOT NULL THEN o.rule_name WHEN t.rule_name IS NOT NULL THEN 'absolute difference' END AS rule_name,
          CASE WHEN o.op IS NOT NULL THEN o.suffixed ELSE t.suffixed END AS suffixed, coalesce(o.rev_ops, false) AS rev_ops, coalesce(o.rev_res, false) AS rev_res
        FROM {_QUESTION_SQL} q
        JOIN (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY n DESC, first_row) AS place FROM op_rules_v) t ON t.problem_id = q.problem_id AND place = 1
        LEFT JOIN op_rules_v o ON o.problem_id = q.problem_id AND o.op = q.op))''')})) WHERE rule_name IS NOT NULL""",
)
add(
    "concatenation_types",
    lambda s, d: rules.concatenation_types(V.equations_v(s, d)),
    ["equations_v"],
    """SELECT problem_id, op, CASE WHEN bool_and(output_value = a || b) THEN 'fwd' WHEN bool_and(output_value = b || a) THEN 'rev' END AS kind FROM equations_v GROUP BY ALL""",
)


def _gate_prompts(spark, sf):
    """Equation prompts of three examples per part; the rule depends on the part."""
    k = F.col("p_partkey")

    def pair(i: int):
        return k * (7 + i) % 80 + 11, k * (3 + 2 * i) % 80 + 11

    def line(i: int):
        x, y = pair(i)
        r = F.when(k % 5 == 0, x + y).when(k % 5 == 1, x * y).when(k % 5 == 2, F.floor(x / y)).when(k % 5 == 3, x % y).otherwise(k % (i + 7))
        return x, y, F.when(k % 10 == 0, F.concat(y.cast("string"), x.cast("string"))).otherwise(r.cast("string"))

    rows = []
    for i in range(3):
        x, y, r = line(i)
        rows.append(F.concat(x.cast("string"), F.lit("@"), y.cast("string"), F.lit(" = "), r))
    x, y, r = line(3)
    text = F.concat(F.lit(synth.EQUATION_INTRO), F.concat_ws("\n", *rows), F.lit("\nNow, determine the result for: "), x.cast("string"), F.lit("@"), y.cast("string"))
    return V.table(spark, sf, "part").select(k.alias("p_partkey"), text.alias("prompt"), r.alias("answer"))


def _gate(spark, sf):
    p = _gate_prompts(spark, sf).withColumn("q", X.parse_equation_prompt(F.col("prompt")))
    name = rules.consistent_rule(F.col("q.examples"), F.col("q.question"), F.col("answer"))
    return p.select("p_partkey", F.col("q.question").alias("question"), F.size("q.examples").alias("examples"), name.alias("rule"))


_GATE_NAMES = [
    "addition", "subtraction", "reverse subtraction", "absolute difference", "multiplication", "concatenation", "reverse concatenation", "integer division", "modulo",
    "reverse integer division", "reverse modulo", "digit add mod10", "digit sub mod10", "cross multiply", "cross multiply reverse", "determinant", "absolute determinant",
]
_GATE_FROM = [3, 6, 7, 4, 8, 1, 2, 16, 17, 18, 19, 21, 22, 23, 24, 31, 32]
add(
    "consistency_gate",
    _gate,
    [],
    f"""SELECT p_partkey, any_value(question) AS question, 3 AS examples, (list_sort(list(g) FILTER (good)))[1] IS NULL AS nothing,
      {'[' + ', '.join(f"'{n}'" for n in _GATE_NAMES) + ']'}[min(g) FILTER (good)] AS rule FROM (
      SELECT p_partkey, g, bool_and(coalesce(rs[{_GATE_FROM}[g]] = r, false)) AS good, max(CASE WHEN i = 3 THEN a || '@' || b END) AS question FROM (
      SELECT *, unnest(range(1, 18)) AS g FROM (SELECT p_partkey, i, r, a, b, {_results_sql()} AS rs FROM {_digits_sql('''(SELECT p_partkey, i,
        CAST(x0 AS VARCHAR) AS a, CAST(y0 AS VARCHAR) AS b, CASE WHEN p_partkey % 10 = 0 THEN y0 || '' || x0 ELSE CAST(CASE p_partkey % 5 WHEN 0 THEN x0 + y0 WHEN 1 THEN x0 * y0
          WHEN 2 THEN x0 // y0 WHEN 3 THEN x0 % y0 ELSE p_partkey % (i + 7) END AS VARCHAR) END AS r
        FROM (SELECT p_partkey, i, p_partkey * (7 + i) % 80 + 11 AS x0, p_partkey * (3 + 2 * i) % 80 + 11 AS y0 FROM part, range(4) t(i)))''')})) GROUP BY p_partkey, g)
      GROUP BY p_partkey""".replace("(list_sort(list(g) FILTER (good)))[1] IS NULL AS nothing,\n", ""),
)

# --- generated problems ----------------------------------------------------------------------


def _seeds(spark, sf, table: str = "customer", key: str = "c_custkey"):
    return V.table(spark, sf, table).select(F.col(key).alias("problem_no"))


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


KINDS = ("concatenation", "splitting", "lstrip")


def _parallel(spark, sf):
    """Lines of all kinds for every customer."""
    made = [synth.parallel_row_lines(_seeds(spark, sf), kind).withColumn("kind", F.lit(kind)) for kind in KINDS]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _parallel_sql(table: str, key: str) -> str:
    bits = lambda *keys: H.counter_bits_sql(0, *keys)
    own = ("kind", "problem_no", "n")
    length = f"""CASE WHEN kind <> 'lstrip' THEN 2 + {bits("'length'", *own)} % 7 WHEN {bits("'half'", *own)} % 2 = 0 THEN 5 ELSE 1 + {bits("'length'", *own)} % 10 END"""
    symbols = f"array_to_string(list_transform(range(1, size + 1), lambda i: {_list_sql(synth.SYMBOLS)}[1 + {bits(*own, 'i')} % {len(synth.SYMBOLS)}]), '')"
    each = "array_to_string(list_transform(string_split(s, ''), lambda c: '【' || c || '】'), '')"
    return f"""(SELECT kind, problem_no, CASE WHEN n < 0 THEN 'demo' ELSE 'row' END AS part, CASE WHEN n < 0 THEN n + 3 ELSE n END AS line_no,
      CASE kind WHEN 'concatenation' THEN {each} WHEN 'splitting' THEN '【' || s || '】' ELSE '【 ' || s || '】' END AS input_text,
      CASE kind WHEN 'splitting' THEN {each} ELSE '【' || s || '】' END AS output_text FROM (
      SELECT *, {symbols} AS s FROM (SELECT *, {length} AS size FROM (
        SELECT {key} AS problem_no, kind, unnest(range(-3, 100)) AS n FROM {table}, (SELECT unnest({_list_sql(KINDS)}) AS kind)))))"""


add("parallel_rows", _parallel, [], f"SELECT * FROM {_parallel_sql('customer', 'c_custkey')}")


def _row_problems(spark, sf):
    made = [synth.row_problems(synth.parallel_row_lines(_seeds(spark, sf, "supplier", "s_suppkey"), kind), kind) for kind in KINDS]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("id", "category", F.md5("prompt").alias("prompt_md5"), F.md5("completion").alias("completion_md5"))


add(
    "parallel_row_problems",
    _row_problems,
    [],
    f"""SELECT substr(sha256(kind || '_' || problem_no), 1, 8) AS id, kind AS category, md5('In Alice''s Wonderland, secret processing rules are used on text.' || chr(10) || chr(10) ||
      'This is a sample input.' || chr(10) || demo_in || chr(10) || chr(10) || 'This is a sample output.' || chr(10) || demo_out || chr(10) || chr(10) || 'This is your input.' || chr(10) || rows_in) AS prompt_md5,
      md5(completion) AS completion_md5 FROM (
      SELECT kind, problem_no, string_agg(given, chr(10) ORDER BY line_no) FILTER (part = 'demo') AS demo_in, string_agg(given || ' -> ' || output_text, chr(10) ORDER BY line_no) FILTER (part = 'demo') AS demo_out,
        string_agg(given, chr(10) ORDER BY line_no) FILTER (part = 'row') AS rows_in, string_agg(given || ' -> ' || output_text, chr(10) ORDER BY line_no) FILTER (part = 'row') AS completion
      FROM (SELECT *, lpad(CAST(line_no AS VARCHAR), 2, '0') || ' ' || input_text AS given FROM {_parallel_sql('supplier', 's_suppkey')}) GROUP BY kind, problem_no)""",
)


def _hindsight(spark, sf):
    made = [synth.hindsight_problems(_seeds(spark, sf), numeric) for numeric in (True, False)]
    parsed = X.parse_equation_prompt(F.col("prompt"))
    explained = rules.consistent_rule(F.col("examples"), F.col("question"), F.col("answer")).isNotNull()
    shown = F.array_join(F.transform("examples", lambda e: F.concat(e["input_value"], F.lit("="), e["output_value"])), " ")
    return made[0].unionByName(made[1]).select(
        "problem_no", "id", "category", "rule", "op", shown.alias("shown"), "question", "answer", F.md5("prompt").alias("prompt_md5"),
        (F.col("category").startswith("crypt") | (explained & (parsed["question"] == F.col("question")))).alias("consistent"),
    )


def _hindsight_sql(numeric: bool) -> str:
    """Drawn rule, operator and five pairs of operands of every seed, and what the rule makes of them."""
    bits = lambda *keys: H.counter_bits_sql(11, *keys)
    if numeric:
        names, category = synth.NUMERIC_PAIRS, "equation_numeric_guess"
        sides = ", ".join(f"lpad(CAST({bits(repr(x), 'problem_no', 'i')} % 100 AS VARCHAR), 2, '0') AS {x}" for x in "ab")
        cases = """WHEN 'addition' THEN CAST(CAST(a AS INT) + CAST(b AS INT) AS VARCHAR) WHEN 'subtraction' THEN CAST(CAST(a AS INT) - CAST(b AS INT) AS VARCHAR)
          WHEN 'absolute difference' THEN CAST(abs(CAST(a AS INT) - CAST(b AS INT)) AS VARCHAR) WHEN 'multiplication' THEN CAST(CAST(a AS INT) * CAST(b AS INT) AS VARCHAR)
          WHEN 'concatenation' THEN a || b ELSE b || a END"""
    else:
        names, category = synth.SYMBOL_PAIRS, "cryptarithm_guess"
        four = f"list_transform(list_sort(list_transform({_list_sql(synth.PUZZLE_SYMBOLS)}, lambda s: {{'h': {bits('problem_no', 'i', 's')}, 's': s}}))[1:4], lambda x: x.s)"
        sides = f"array_to_string(({four})[1:2], '') AS a, array_to_string(({four})[3:4], '') AS b"
        cases = "WHEN 'both' THEN a || b WHEN 'both turned' THEN b || a WHEN 'first' THEN a WHEN 'second' THEN b ELSE left(a, 1) || right(b, 1) END"
    ops = _list_sql(synth.OPERATORS)
    return f"""SELECT problem_no, substr(sha256('her_{category}_' || problem_no), 1, 8) AS id, '{category}' AS category, rule, op,
      string_agg(a || op || b || '=' || r, ' ' ORDER BY i) FILTER (i < 5) AS shown, max(a || op || b) FILTER (i = 5) AS question, max(r) FILTER (i = 5) AS answer,
      md5('{synth.EQUATION_INTRO.replace("'", "''")}' || string_agg(a || op || b || ' = ' || r, chr(10) ORDER BY i) FILTER (i < 5) || chr(10) ||
        'Now, determine the result for: ' || max(a || op || b) FILTER (i = 5)) AS prompt_md5, true AS consistent FROM (
      SELECT *, CASE rule {cases} AS r FROM (
        SELECT *, {_list_sql(names)}[1 + {bits("'rule'", "problem_no")} % {len(names)}] AS rule, {ops}[1 + {bits("'op'", "problem_no")} % {len(synth.OPERATORS)}] AS op, {sides}
        FROM (SELECT c_custkey AS problem_no, unnest(range(1, 6)) AS i FROM customer))) GROUP BY problem_no, rule, op"""


add("hindsight_problems", _hindsight, [], f"{_hindsight_sql(True)} UNION ALL {_hindsight_sql(False)}")


def _vectors(spark, sf):
    return rules.infer_bit_rules(V.bit_examples_v(spark, sf))


def _evolved(spark, sf):
    e = synth.evolve_bit_problems(_vectors(spark, sf), ["add_operand", "longer_chain", "nest_op"])
    inputs = F.transform("examples", lambda x: x["input_value"])
    ok = (F.size(F.array_distinct(inputs)) == 8) & ~F.array_contains(inputs, F.col("question"))
    return e.select("problem_id", "op", "question", "answer", ok.alias("distinct_inputs"))


add("evolve_bit_problems", _evolved)


def _evolved_equations(spark, sf):
    k = F.col("s_suppkey")
    seeds = V.table(spark, sf, "supplier").select(k.cast("string").alias("problem_id"), F.element_at(F.array(F.lit("+"), F.lit("*")), (k % 2 + 1).cast("int")).alias("op"))
    made = synth.verified_equations(synth.evolve_equations(seeds, variants=4))
    shown = F.array_join(F.transform("examples", lambda e: F.concat(e["input_value"], F.lit("="), e["output_value"])), ";")
    return made.select("problem_id", "seed_id", "rule", shown.alias("examples"), "question", "answer")


_EVOLVED = f"""(SELECT *, CASE rule WHEN 'addition' THEN CAST(a + b AS VARCHAR) WHEN 'absolute difference' THEN CAST(abs(a - b) AS VARCHAR)
      WHEN 'multiplication' THEN CAST(a * b AS VARCHAR) ELSE CAST(a AS VARCHAR) || CAST(b AS VARCHAR) END AS result FROM (
    SELECT *, 12 + ({H.counter_int_sql(0, 87, 1234, "'a'", "seed_id", "v")} + i * 21) % 88 AS a, {H.counter_int_sql(11, 98, 1234, "'b'", "seed_id", "v", "i")} AS b FROM (
      SELECT *, seed_id || '__e' || v || '_' || replace(rule, ' ', '_') AS problem_id, unnest(range(1, 5)) AS i FROM (
        SELECT *, {synth.EQUATION_RULES}[v + 1] AS rule FROM (
          SELECT CAST(s_suppkey AS VARCHAR) AS seed_id, ['+', '*'][s_suppkey % 2 + 1] AS op, unnest(range(4)) AS v FROM supplier)))))"""
_SOLVED = QUERIES["solve_equations"].sql.replace(
    V.SQL_VIEWS["equations_v"][1],
    f"SELECT problem_id, i - 1 AS row_no, CAST(a AS VARCHAR) AS a, op, CAST(b AS VARCHAR) AS b, result AS output_value FROM {_EVOLVED} WHERE i < 4",
).replace(_QUESTION_SQL, f"(SELECT problem_id, CAST(a AS VARCHAR) AS a, op, CAST(b AS VARCHAR) AS b FROM {_EVOLVED} WHERE i = 4)")
add(
    "evolve_equations",
    _evolved_equations,
    [],
    f"""SELECT problem_id, seed_id, rule, examples, question, answer FROM (
      SELECT problem_id, seed_id, any_value(rule) AS rule, string_agg(a || op || b || '=' || result, ';' ORDER BY i) FILTER (i < 4) AS examples,
        max(a || op || b) FILTER (i = 4) AS question, max(result) FILTER (i = 4) AS answer FROM {_EVOLVED} GROUP BY problem_id, seed_id)
      JOIN (SELECT problem_id, solution FROM ({_SOLVED})) USING (problem_id) WHERE {V.match_sql("answer", "solution")}""",
)


def _curriculum(spark, sf):
    vectors = _vectors(spark, sf)
    seeds = V.bit_examples_v(spark, sf).groupBy("problem_id").agg(F.count("*").alias("n_examples")).join(vectors.select("problem_id"), "problem_id", "left_semi")
    made = synth.short_curriculum(vectors, variants=2)
    return synth.curriculum_tiers(seeds, made)


add("length_curriculum", _curriculum)


def _weak_problems(spark, sf):
    w = synth.weakness_problems(_weakness(spark, sf), top_k=3, per_family=50)
    return w.groupBy("family").agg(F.count("*").alias("problems"), F.max("problem_no").alias("last_no"))


add("weakness_problems", _weak_problems)


def _pools(spark, sf):
    """All words of the documents, and all of the conversations."""
    tables = ("documents", "conversations")
    return [V.table(spark, sf, t).select(F.explode(F.split("text", " ")).alias("token")).filter("token <> ''").distinct() for t in tables]


_POOL = """(SELECT token, row_number() OVER (ORDER BY {bits}, token) AS rk, count(*) OVER () AS n FROM (
      SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM {t}) WHERE token <> ''))"""
_BARE, _SPACED = (_POOL.format(t=t, bits=H.counter_bits_sql(42, "token")) for t in ("documents", "conversations"))
_LINES = """lines AS (SELECT problem_no, line_no, b.token || ' ' || s1.token || ' ' || s2.token AS input_text FROM (
      SELECT t // 100 AS problem_no, t % 100 AS line_no, t % nb + 1 AS kb, 2 * t % ns + 1 AS k1, (2 * t + 1) % ns + 1 AS k2 FROM (
        SELECT nb, ns, unnest(range(100 * CAST(greatest(ceil(nb * 4 / 100), ceil(ns * 4 / 200)) AS BIGINT))) AS t FROM sizes))
      JOIN bare b ON b.rk = kb JOIN spaced s1 ON s1.rk = k1 JOIN spaced s2 ON s2.rk = k2)"""
_SPELL_SQL = f"""WITH bare AS {_BARE}, spaced AS {_SPACED}, sizes AS (SELECT (SELECT max(n) FROM bare) AS nb, (SELECT max(n) FROM spaced) AS ns), {_LINES}"""
_SPELLED = "'–' || array_to_string(list_filter(string_split(input_text, ''), lambda c: c <> ' '), '–') || '–'"
add(
    "spelling_schedule",
    lambda s, d: synth.spelling_lines(*_pools(s, d)),
    [],
    f"{_SPELL_SQL} SELECT problem_no, line_no, input_text, {_SPELLED} AS output_text FROM lines",
)
_DRAW = {n: H.counter_bits_sql(42, f"'{n}'", "problem_no", "line_no") for n in ("b", "s1", "s2")}
add(
    "spelling_problems",
    lambda s, d: synth.spelling_problems(*_pools(s, d)).select("id", "category", F.md5("prompt").alias("prompt_md5"), F.md5("completion").alias("completion_md5")),
    [],
    f"""{_SPELL_SQL}, demos AS (SELECT problem_no, line_no, b.token || ' ' || s1.token || ' ' || s2.token AS input_text FROM (
      SELECT problem_no, line_no, {_DRAW['b']} % nb + 1 AS kb, {_DRAW['s1']} % ns + 1 AS k1, {_DRAW['s2']} % ns + 1 AS k2
      FROM (SELECT DISTINCT problem_no FROM lines), (SELECT unnest(range(3)) AS line_no), sizes)
      JOIN bare b ON b.rk = kb JOIN spaced s1 ON s1.rk = k1 JOIN spaced s2 ON s2.rk = k2),
    shown AS (SELECT problem_no, line_no, part, lpad(CAST(line_no AS VARCHAR), 2, '0') || chr(10) || input_text AS given, {_SPELLED} AS spelled FROM (
      SELECT *, 'row' AS part FROM lines UNION ALL SELECT *, 'demo' FROM demos)),
    blocks AS (SELECT problem_no, string_agg(given, chr(10) ORDER BY line_no) FILTER (part = 'demo') AS demo_in, string_agg(given || ' -> ' || spelled, chr(10) ORDER BY line_no) FILTER (part = 'demo') AS demo_out,
      string_agg(given, chr(10) ORDER BY line_no) FILTER (part = 'row') AS rows_in, string_agg(given || ' -> ' || spelled, chr(10) ORDER BY line_no) FILTER (part = 'row') AS completion
      FROM shown GROUP BY problem_no)
    SELECT substr(sha256('spelling_' || problem_no), 1, 8) AS id, 'spelling' AS category, md5('In Alice''s Wonderland, secret processing rules are used on text.' || chr(10) || chr(10) ||
      'This is a sample input.' || chr(10) || demo_in || chr(10) || chr(10) || 'This is a sample output.' || chr(10) || demo_out || chr(10) || chr(10) ||
      'This is your input.' || chr(10) || rows_in) AS prompt_md5, md5(completion) AS completion_md5 FROM blocks""",
)


def _traces(spark, sf):
    """Bit traces written from the customer table."""
    k = F.col("c_custkey")
    key = k.cast("string")
    block = F.concat_ws("\n", *[F.concat(F.lit(f"{i} "), key) for i in range(8)])
    match = F.when(k % 3 == 0, F.lit("absent")).otherwise(F.concat(F.lit("3 match "), key))
    left = F.when(k % 2 == 0, F.lit("none")).otherwise(F.concat(F.lit("1x "), key))
    text = F.concat_ws(
        "\n",
        F.lit("Intro"),
        F.lit(synth.OUTPUT_COLUMNS),
        block,
        F.lit(""),
        F.lit("Identity"),
        match,
        F.lit("5 tail\n\n"),
        F.lit("Matching output"),
        F.concat(F.lit("m "), key),
        F.lit(""),
        F.lit("Left"),
        left,
        F.lit("Best: I3"),
        F.lit(""),
        F.lit("Right"),
        F.lit("none"),
        F.lit("Best: none"),
        F.lit(""),
        F.lit("AND-NOT"),
        F.lit("7 match\n8 match\n9 match\n6 match"),
        F.lit("Matching output"),
        F.lit("Left"),
        F.lit("2y"),
        F.lit(""),
        F.lit("Right"),
        F.lit("4"),
        F.lit("Best: AND-NOT45"),
        F.lit("Selecting"),
        F.lit("OR"),
    )
    return V.table(spark, sf, "customer").select(F.concat(key, F.lit(".txt")).alias("file"), text.alias("text"))


_HEAD = "array_to_string(list_transform(range(8), lambda i: i || ' ' || c_custkey), chr(10))"
_SECTIONS = f"""(SELECT c_custkey || '.txt' AS file, 'Identity' AS section, {_HEAD} || chr(10) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'absent' ELSE '3 match ' || c_custkey END || chr(10) || '5 tail' AS input,
  'm ' || c_custkey || chr(10) || chr(10) || 'Left' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'none' ELSE '1x ' || c_custkey END || chr(10) || 'Best: 3' || chr(10) || chr(10) || 'Right' ||
    chr(10) || 'none' || chr(10) || 'Best: none' AS output, c_custkey % 2 = 1 AS has_x, false AS has_y, c_custkey % 3 = 0 AS all_absent, c_custkey % 2 = 0 AS both_none, true AS few_matches FROM customer
  UNION ALL SELECT c_custkey || '.txt', 'AND-NOT', {_HEAD} || chr(10) || chr(10) || '7 match' || chr(10) || '8 match' || chr(10) || '9 match' || chr(10) || '6 match',
  chr(10) || 'Left' || chr(10) || '2y' || chr(10) || chr(10) || chr(10) || 'Right' || chr(10) || '4' || chr(10) || 'Best: 45', false, true, false, false, false FROM customer)"""
add("matching_sections", lambda s, d: synth.matching_sections(_traces(s, d)), [], f"SELECT * FROM {_SECTIONS}")
_MOD = """list_reduce(list_transform(range(64), lambda i: CAST(strpos('0123456789abcdef', h[i + 1]) - 1 AS BIGINT)), lambda a, b: (a * 16 + b) % 100)"""
add(
    "keep_by_sparsity",
    lambda s, d: synth.keep_by_sparsity(synth.matching_sections(_traces(s, d))).select("file", "section"),
    [],
    f"""SELECT file, section FROM (SELECT *, {_MOD} % 100 AS m FROM (SELECT *, sha256(file || '_' || section) AS h FROM {_SECTIONS}))
      WHERE CASE WHEN all_absent THEN m = 0 WHEN both_none THEN m % 10 = 0 WHEN few_matches THEN m % 5 = 0 ELSE true END""",
)


def _matching_problems(spark, sf):
    sections = synth.matching_sections(_traces(spark, sf))
    n = F.substring_index("file", ".", 1).cast("bigint") * 2 + F.when(F.col("section") == "Identity", 0).otherwise(1)
    return synth.matching_problems(sections.withColumn("n", n)).select("id", "category", "completion", F.md5("prompt").alias("prompt_md5"))


add(
    "matching_problems",
    _matching_problems,
    [],
    f"""SELECT substr(sha256('matching_' || (CAST(split_part(file, '.', 1) AS BIGINT) * 2 + CASE section WHEN 'Identity' THEN 0 ELSE 1 END)), 1, 8) AS id, 'matching' AS category, output AS completion,
      md5('In Alice''s Wonderland, secret processing rules are used on text.' || chr(10) || chr(10) || 'x: not matched anywhere' || chr(10) || 'y: matched but wrong position' ||
      chr(10) || chr(10) || input) AS prompt_md5 FROM {_SECTIONS}""",
)
