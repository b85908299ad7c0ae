"""Round trips: driver tables written in a source's format below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..operators import reports, rollouts
from ..operators.mixing import union_parts
from ..session import shared_folder
from ..sources import budget, store
from ..sources import tables as S
from . import mix_queries
from . import views as V
from .views import Query

QUERIES: dict[str, Query] = {}


def add(name, run, sql) -> None:
    QUERIES[name] = Query(run, sql)


def _jsonl(spark, sf):
    """Documents dealt over two folders by id and written in its order, in as many files as they need; row numbers
    give the order back."""
    rows = V.table(spark, sf, "documents").select("doc_id", "lang", F.split("text", " ").alias("tokens"))
    path = shared_folder(spark, "jsonl")
    S.write_jsonl(rows.filter("doc_id % 2 = 0").repartitionByRange("doc_id").sortWithinPartitions("doc_id"), f"{path}/1")
    S.write_jsonl(rows.filter("doc_id % 2 <> 0").repartitionByRange("doc_id").sortWithinPartitions("doc_id"), f"{path}/2")
    back = S.read_numbered_jsonl(spark, [f"{path}/1", f"{path}/2"], rows.schema)
    return back.select("doc_id", "lang", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("text_md5"), "row_no")


add(
    "jsonl_round_trip",
    _jsonl,
    """SELECT doc_id, lang, len(string_split(text, ' ')) AS n, md5(text) AS text_md5, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS row_no
      FROM documents""",
)


def _index_files(spark, sf):
    docs = V.table(spark, sf, "documents")
    root = shared_folder(spark, "index")
    # The last file has a line for every document, some of them two.
    rest = docs.select(F.col("doc_id").cast("string").alias("id"), F.upper("lang").alias("category"))
    again = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("id"), F.concat("lang", "source").alias("category"))
    S.write_jsonl(rest.repartition(3), f"{root}/rest/a")
    S.write_jsonl(again.repartition(2), f"{root}/rest/b")
    one = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"))
    two = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("problem_id"), F.col("source").alias("category"))
    S.write_jsonl(one, f"{root}/one")
    S.write_jsonl(two, f"{root}/two")
    S.write_jsonl(one.limit(0), f"{root}/none")
    whole = f"{root}/rest/*"
    return {"first": [f"{root}/missing", f"{root}/none", whole, f"{root}/one"], "merged": [f"{root}/missing", whole, f"{root}/one", f"{root}/two"]}


add(
    "category_map_first",
    lambda s, d: S.category_map(s, _index_files(s, d)["first"]),
    "SELECT CAST(doc_id AS VARCHAR) AS problem_id, CASE WHEN doc_id % 5 = 0 THEN lang || source ELSE upper(lang) END AS category FROM documents",
)
add(
    "category_map_merged",
    lambda s, d: S.category_map(s, _index_files(s, d)["merged"], merge_all=True),
    """SELECT CAST(doc_id AS VARCHAR) AS problem_id, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN lang
      WHEN doc_id % 5 = 0 THEN lang || source ELSE upper(lang) END AS category FROM documents""",
)


def _prompts(spark, sf):
    doc = F.col("doc_id")
    rows = V.table(spark, sf, "documents").select(
        F.when(doc % 7 != 0, doc.cast("string")).otherwise("").alias("id"),
        F.when(doc % 11 != 0, F.concat(F.lit("p"), doc)).otherwise("").alias("problem_id"),
        F.concat(F.lit('"'), "text", F.lit('", said')).alias("prompt"),
        F.col("source").alias("answer"),
        F.when(doc % 5 != 0, F.col("lang")).alias("category"),
    )
    path = shared_folder(spark, "prompts")
    rows.write.csv(path, header=True, escape='"')
    known = V.table(spark, sf, "documents").filter("doc_id % 10 = 0").select(doc.cast("string").alias("problem_id"), F.lit("known").alias("category"))
    return S.read_prompts(spark, path, known).select("id", F.md5("prompt").alias("prompt_md5"), "answer", "category")


add(
    "prompt_csv",
    _prompts,
    """SELECT CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE 'p' || doc_id END AS id, md5('"' || text || '", said') AS prompt_md5, source AS answer,
      CASE WHEN doc_id % 5 <> 0 THEN lang WHEN doc_id % 10 = 0 AND doc_id % 7 <> 0 THEN 'known' ELSE 'unknown' END AS category
      FROM documents WHERE doc_id % 77 <> 0""",
)


def _details(spark, sf):
    example = F.struct(F.col("s_name").alias("input_value"), F.lower("s_name").alias("output_value"))
    detail = F.struct(
        F.col("s_suppkey").cast("string").alias("id"), F.lit("supplier").alias("category"), F.col("s_name").alias("question"), F.array(example).alias("examples")
    )
    ignored = F.struct(F.lit("ignored").alias("id"))
    rows = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("file"), F.concat_ws("\n", F.to_json(detail), F.to_json(ignored)).alias("value")
    )
    path = shared_folder(spark, "details")
    rows.write.partitionBy("file").text(path)
    back = S.read_problem_details(spark, path)
    return back.select("id", "category", "question", F.col("examples")[0]["output_value"].alias("first_output"))


add(
    "problem_details",
    _details,
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, 'supplier' AS category, s_name AS question, lower(s_name) AS first_output FROM supplier",
)


def _sectioned(spark, sf):
    rows = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("nation "), "s_nationkey").alias("category"),
        F.concat("s_name", F.lit("\nsecond line\n[completion] inside")).alias("prompt"),
        F.concat(F.lit("done\n\n"), "s_suppkey").alias("completion"),
    )
    path = shared_folder(spark, "sectioned")
    S.write_sectioned_text(rows, path)
    return S.read_sectioned_text(spark, path).select("category", "prompt", "completion")


add(
    "sectioned_text",
    _sectioned,
    """SELECT 'nation ' || s_nationkey AS category, s_name || chr(10) || 'second line' || chr(10) || '[completion] inside' AS prompt,
      'done' || chr(10) || chr(10) || s_suppkey AS completion FROM supplier""",
)


def _records(spark, sf):
    rows = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.concat(F.col("text"), F.lit("\n[completion] inside")).alias("prompt"), F.concat(F.lit("\n"), F.upper("source")).alias("completion")
    )
    path = shared_folder(spark, "records")
    S.write_sectioned_records(rows, path)
    return S.read_sectioned_records(spark, path).select("id", "category", F.md5("prompt").alias("prompt_md5"), "completion")


add(
    "sectioned_records",
    _records,
    """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category, md5(text || chr(10) || '[completion] inside') AS prompt_md5, chr(10) || upper(source) AS completion FROM documents""",
)


def _kinds(spark, sf):
    tables = {"corpus": V.corpus_v(spark, sf), "rollouts": V.corpus_v(spark, sf).withColumn("reward", F.lit(1.0)), "documents": V.table(spark, sf, "documents")}
    told = [
        df.groupBy(F.lit(name).alias("name"), F.lit(reports.is_corpus_table(df)).alias("is_corpus")).agg(F.count("*").alias("rows"))
        for name, df in tables.items()
    ]
    return told[0].unionByName(told[1]).unionByName(told[2])


add(
    "table_kind",
    _kinds,
    "SELECT name, name = 'corpus' AS is_corpus, count(*) AS rows FROM documents, (VALUES ('corpus'), ('rollouts'), ('documents')) t(name) GROUP BY name",
)


def _parts(spark, sf):
    rows = V.corpus_v(spark, sf).withColumn("tokens", F.transform("tokens", F.length))
    root = shared_folder(spark, "parts")
    names = [f"{root}/other/S_one.jsonl", "S_one", "N_two.jsonl"]
    places = [names[0], f"{root}/corpus/parts/S_one.jsonl", f"{root}/corpus/parts/N_two.jsonl"]
    for k, place in enumerate(places):
        keep = [f.name for f in schemas.CORPUS_ROW.fields if f.name in rows.columns]
        S.write_jsonl(rows.filter(F.col("part_index") == k).select(*keep), place)
    merged = union_parts(S.read_parts(spark, names, root))
    n = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return merged.select("part_index", "part", "source", "problem_id", n.alias("n_chars"), F.size("mask").alias("n"))


add(
    "corpus_parts",
    _parts,
    """SELECT CAST(doc_id % 3 AS INTEGER) AS part_index, CASE doc_id % 3 WHEN 2 THEN 'N_two' ELSE 'S_one' END AS part,
      CASE doc_id % 3 WHEN 2 THEN 'N' ELSE 'S' END AS source, CAST(doc_id % 400 AS VARCHAR) AS problem_id,
      CAST(length(replace(text, ' ', '')) AS BIGINT) AS n_chars, len(string_split(text, ' ')) AS n FROM documents""",
)


def _part_folders(spark, sf):
    """The parts as files in order: four, five and six, and more where the documents are read in more splits."""
    rows = V.corpus_v(spark, sf)
    splits = spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()
    root = shared_folder(spark, "part-files")
    parts = [(name, f"{root}/{i}") for i, name in enumerate(V.PARTS)]
    for i, (_, path) in enumerate(parts):
        own = rows.filter(F.col("part_index") == i).withColumn("own_no", F.col("row_no"))
        budget.written_in_order(own.drop("part", "part_index", "source"), path, "row_no", max(4 + i, splits))
    return parts


def _merged_files(spark, sf):
    counts = rollouts.capped_pass_counts(V.graded_v(spark, sf), V.ORDER)
    rows = budget.merge_files(
        spark, _part_folders(spark, sf), 200000, drop_rules=mix_queries.RULES, dedup_ids=True, pass_counts=counts, boundary=1.5, mastered=0.5
    )
    return rows.select("problem_id", "category", "part_index", "weight", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("digest"))


add(
    "merge_files_to_budget",
    _merged_files,
    V.with_views(
        ["merge_v"],
        """SELECT problem_id, category, part_index, CASE WHEN pass_count BETWEEN 1 AND 7 THEN 1.5 WHEN pass_count >= 8 THEN 0.5 ELSE 1.0 END AS weight,
      n_tokens, md5(text) AS digest FROM merge_v WHERE emitted""",
    ),
)


def _bucketed(spark, sf):
    """Graded rollouts kept by stage and problem; probes meet the last rewarded row of their problem."""
    graded = V.graded_v(spark, sf).select("problem_id", "row_no", "stage", "reward")
    name = f"rollouts_{uuid.uuid4().hex}"
    kept = store.write_bucketed(graded, name, shared_folder(spark, "bucketed"), ["problem_id"], ["stage"], 8)
    gold = kept.filter("reward > 0").groupBy("problem_id").agg(F.max("row_no").alias("gold_row"))
    probes = kept.filter("stage = 'probe'").join(gold, "problem_id", "left")
    return probes.groupBy("problem_id").agg(F.count("*").alias("probes"), F.max("gold_row").alias("gold_row"))


add(
    "bucketed_gold_join",
    _bucketed,
    V.with_views(
        ["graded_v"],
        """SELECT problem_id, count(*) FILTER (stage = 'probe') AS probes, max(row_no) FILTER (reward > 0) AS gold_row
      FROM graded_v GROUP BY problem_id HAVING count(*) FILTER (stage = 'probe') > 0""",
    ),
)
