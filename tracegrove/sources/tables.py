"""Readers and writers of the file formats the tables travel in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..functions import tokens as K
from ..functions.text import join_vocab_pieces, passes
from ..operators.ordering import last_per_key
from ..operators.trainlog import split_raw_tokens
from ..session import shared_folder


def with_row_no(df: DataFrame) -> DataFrame:
    """Add ``row_no`` in the order of this read, for tables that do not carry one.

    Numbers grow but have gaps. Store the result before using it: they depend on how the read was split;
    :func:`read_numbered_jsonl` has numbers that do not.
    """
    return df.withColumn("row_no", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row_no, value) of text lines, numbered from 0 through all files in the order of their paths.

    A file is read in blocks. Lines are counted per block, the blocks' first numbers are their running total,
    and a line adds its place in its block. So numbers are the same however the read was split and no line
    is shuffled or sorted; only the block table (one row for each) is.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    # The lines of a block stand next to each other in one partition.
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.orderBy("file", "_block").rowsBetween(W.unboundedPreceding, -1))
    table = shared_folder(spark, "blocks")
    blocks.select("file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before")).write.parquet(table)
    starts = spark.read.parquet(table)  # of known size, so that Spark broadcasts it if it is small
    numbered = lines.join(starts, ["file", "_block"])
    return numbered.select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("row_no"), "value")


def read_numbered_jsonl(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines under a declared schema with ``file`` and ``row_no``, the number of the line (see
    :func:`numbered_lines`); blank lines count but give no row."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select("file", "row_no", F.from_json("value", schema).alias("_row")).select("_row.*", "file", "row_no")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), append: bool = False) -> None:
    """Parquet, by default the form tables are kept in (partition by category or stage)."""
    df.write.mode("append" if append else "overwrite").partitionBy(*partition_by).parquet(path)


def read_prompts(
    spark: SparkSession, path: str, categories: DataFrame | None = None, only_category: str | None = None
) -> DataFrame:
    """Prompt CSV as (id, prompt, answer, category).

    The id may stand in ``problem_id``; rows without any id are dropped. A missing category
    comes from ``categories`` (problem_id, category), else it is ``unknown``.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    blank = F.lit("")

    def column(name: str) -> Column:
        return F.nullif(F.col(name), blank) if name in raw.columns else F.lit(None).cast("string")

    rows = raw.select(
        F.coalesce(column("id"), column("problem_id")).alias("id"),
        F.coalesce(column("prompt"), blank).alias("prompt"),
        F.coalesce(column("answer"), blank).alias("answer"),
        column("category").alias("category"),
    ).filter(F.col("id").isNotNull())
    if categories is not None:
        known = categories.select(F.col("problem_id").alias("id"), F.col("category").alias("_mapped"))
        rows = rows.join(known, "id", "left").withColumn("category", F.coalesce("category", "_mapped")).drop("_mapped")
    rows = rows.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return rows if only_category is None else rows.filter(F.col("category") == only_category)


def _index_file(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        raw = spark.read.schema("id string, problem_id string, category string").json(path)
        raw.schema  # noqa: B018
    except AnalysisException:
        return None
    key = F.coalesce(F.nullif("problem_id", F.lit("")), F.nullif("id", F.lit("")))
    rows = read_numbered_jsonl(spark, path, raw.schema)
    rows = rows.select(key.alias("problem_id"), F.nullif("category", F.lit("")).alias("category"), "row_no")
    return rows.filter(F.col("problem_id").isNotNull() & F.col("category").isNotNull())


def category_map(spark: SparkSession, paths: Sequence[str], merge_all: bool = False) -> DataFrame:
    """(problem_id, category) of the first index file that has entries.

    With ``merge_all`` all files count and later files win. The last line of an id wins.
    """
    found = [(i, df) for i, df in ((i, _index_file(spark, p)) for i, p in enumerate(paths)) if df is not None]
    if not merge_all:
        found = next(([(i, df)] for i, df in found if not df.isEmpty()), [])
    if not found:
        return spark.createDataFrame([], "problem_id string, category string")
    merged = None
    for i, df in found:
        tagged = df.withColumn("file_no", F.lit(i))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return last_per_key(merged, ["problem_id"], ["file_no", "row_no"]).select("problem_id", "category")


def read_problem_details(spark: SparkSession, path: str) -> DataFrame:
    """One problem per file, of which only the first line counts."""
    text = spark.read.text(path, wholetext=True)
    first = F.split_part(F.ltrim(F.col("value"), F.lit("\r\n")), F.lit("\n"), F.lit(1))
    parsed = text.select(F.from_json(first, schemas.PROBLEM.simpleString()).alias("p"))
    return parsed.filter(F.col("p").isNotNull()).select("p.*")


SECTIONED = r"(?s)^\[category\]\n(.*?)\n\[prompt\]\n(.*?)\n\[completion\]\n(.*)$"


def read_sectioned_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, prompt, completion) of ``[category]/[prompt]/[completion]`` files."""
    text = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    parts = [F.regexp_extract("value", SECTIONED, i) for i in (1, 2, 3)]
    return text.select(
        F.regexp_replace("name", r"\.[^.]*$", "").alias("id"),
        parts[0].alias("category"),
        parts[1].alias("prompt"),
        F.rtrim(parts[2], F.lit("\n")).alias("completion"),
    )


def sectioned_text(df: DataFrame) -> DataFrame:
    """(id, value) with the file text of each record."""
    value = F.format_string("[category]\n%s\n[prompt]\n%s\n[completion]\n%s\n", "category", "prompt", "completion")
    return df.select("id", value.alias("value"))


def write_sectioned_text(df: DataFrame, path: str) -> None:
    """One folder per id with the record as text."""
    # The writer ends the text with the line break that it lacks here.
    whole = sectioned_text(df).withColumn("value", F.expr("substring(value, 1, length(value) - 1)"))
    whole.write.mode("overwrite").partitionBy("id").text(path)


#: Ends a record in a file of many; no text may hold it.
RECORD_END = "\x1e\n"


def write_sectioned_records(df: DataFrame, path: str) -> None:
    """Records (id, category, prompt, completion) as sectioned text, many in a file, each with its id in a section of
    its own. A folder for each record, as :func:`write_sectioned_text` has, does not scale to millions."""
    value = F.concat(F.lit("[id]\n"), F.col("id").cast("string"), F.lit("\n"), F.col("value"))
    rows = sectioned_text(df).select("id", value.alias("value"))
    message = F.concat(F.col("id").cast("string"), F.lit(": the text holds the end of a record"))
    rows.filter(passes(F.col("value").contains(RECORD_END), message)).select("value").write.mode("overwrite").option("lineSep", RECORD_END).text(path)


def read_sectioned_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, prompt, completion) of :func:`write_sectioned_records`; files are read in blocks."""
    text = spark.read.option("lineSep", RECORD_END).text(path)
    pattern = SECTIONED.replace(r"(?s)^", r"(?s)^\[id\]\n(.*?)\n", 1)
    parts = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3, 4)]
    return text.select(
        parts[0].alias("id"), parts[1].alias("category"), parts[2].alias("prompt"), F.rtrim(parts[3], F.lit("\n")).alias("completion")
    )


def segments_of(rows: DataFrame) -> DataFrame:
    """Corpus rows as segment lines (problem_id, type, pos, tokens)."""
    return rows.select("problem_id", F.inline(K.segments(F.col("tokens"), F.col("mask"))))


#: Parts the tokens of a segment while it moves; the least character, so that texts sort as the arrays do.
TOKEN_END = "\x00"


def _packed_segments(segments: DataFrame, of_strings: bool) -> DataFrame:
    """(problem_id, _segment), the segments as they move: a flag for the two types, and string tokens as one text, which
    takes a fraction of an array of strings. Tokens a text would not give back as they are stay an array."""
    kind, tokens = F.col("type"), F.col("tokens")
    flag = F.when(kind == "unmasked", True).when(kind == "masked", False)
    head = [F.col("pos"), flag.alias("flag"), F.when(flag.isNull(), kind).alias("type")]
    if not of_strings:
        return segments.select("problem_id", F.struct(*head, "tokens").alias("_segment"))
    texts = segments.withColumn("_text", F.array_join(tokens, TOKEN_END))
    texts = texts.withColumn("_whole", F.coalesce(F.split("_text", TOKEN_END) == tokens, F.lit(False)))
    body = [F.when(F.col("_whole"), F.col("_text")).alias("text"), F.when(~F.col("_whole"), tokens).alias("tokens")]
    return texts.select("problem_id", F.struct(*head, *body).alias("_segment"))


def _unpacked_segment(s: Column, of_strings: bool) -> Column:
    kind = F.when(s["flag"], "unmasked").when(~s["flag"], "masked").otherwise(s["type"])
    tokens = F.coalesce(F.split(s["text"], TOKEN_END), s["tokens"]) if of_strings else s["tokens"]
    return F.struct(s["pos"].alias("pos"), kind.alias("type"), tokens.alias("tokens"))


def rows_from_segments(segments: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(problem_id, tokens, mask) from segment lines in ``pos`` order.

    A problem has at most as many segments as tokens, which the token limit bounds. With an
    index only included problems count, and differing token counts fail the job.
    """
    of_strings = isinstance(segments.schema["tokens"].dataType.elementType, StringType)
    packed = _packed_segments(segments, of_strings)
    ordered = packed.groupBy("problem_id").agg(F.sort_array(F.collect_list("_segment")).alias("_segments"))
    unpacked = F.transform("_segments", lambda s: _unpacked_segment(s, of_strings))
    tokens, mask = K.tokens_and_mask(F.col("_segments"))
    if index is None:
        return ordered.withColumn("_segments", unpacked).select("problem_id", tokens.alias("tokens"), mask.alias("mask"))
    wanted = index.filter("included").select("problem_id", "category", "token_count", "unmasked_token_count")
    # Joined as they were moved; the arrays of a row are made once it is matched.
    joined = wanted.join(ordered, "problem_id", "left").withColumn("_segments", unpacked)
    joined = joined.select(*wanted.columns, tokens.alias("tokens"), mask.alias("mask"))
    n, trained = F.size("tokens"), K.trained_count(F.col("mask"))
    bad = F.col("tokens").isNull() | (n != F.col("token_count")) | (trained != F.coalesce("unmasked_token_count", trained))
    message = F.concat("problem_id", F.lit(": segments do not match the index"))
    return joined.filter(passes(bad, message)).select(
        "problem_id",
        "category",
        "tokens",
        "mask",
        F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("sign"),
    )


def write_segments(rows: DataFrame, path: str) -> None:
    """Segment lines as JSON, one folder per problem."""
    segments_of(rows).write.mode("overwrite").partitionBy("problem_id").json(path)


def split_raw_runs(raw: DataFrame, prompt_marker: float | None = None) -> DataFrame:
    """(problem_id, run, prompt_ids, generated_ids) of token lines.

    ``raw``: problem_id, run, token_no, token_id, logprob. A run's length is bounded by the
    model's context, so its tokens may be gathered into one row.
    """
    entry = F.struct("token_no", "token_id", "logprob")
    runs = raw.groupBy("problem_id", "run").agg(F.array_sort(F.collect_list(entry)).alias("_t"))
    prompt, made = split_raw_tokens(F.col("_t"), prompt_marker)
    return runs.select("problem_id", "run", prompt.alias("prompt_ids"), made.alias("generated_ids"))


def detokenise(
    rows: DataFrame, ids: str, vocab: DataFrame, keys: Sequence[str], unknown: str = "<unk:%d>", name: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Add the text of a token-id column. ``keys`` are the columns that identify a row.

    Ids meet the vocabulary in an equi-join; the pieces of a row, bounded by its token limit,
    come back together in order.
    """
    rest = [c for c in rows.columns if c not in keys and (keep_ids or c != ids)]
    whole = F.struct(*rest) if rest else F.lit(None).cast("boolean")
    exploded = rows.select(*keys, F.col(ids).alias("_ids"), whole.alias("_row")).select(
        *keys, "_row", F.posexplode_outer("_ids").alias("_at", "token_id")
    )
    nth = F.row_number().over(W.partitionBy("token_id").orderBy("token"))
    known = vocab.select("token_id", "token", nth.alias("_nth"))
    # The other columns of a row travel with its first piece, so the rows are not moved once more to meet their texts.
    first = F.coalesce(F.col("_at") == 0, F.lit(True)) & (F.coalesce("_nth", F.lit(1)) == 1)
    piece = F.struct("_at", F.coalesce("token", F.format_string(unknown, "token_id")).alias("t"))
    pieces = exploded.join(known, "token_id", "left").select(
        *keys, F.when(F.col("_at").isNotNull(), piece).alias("p"), first.alias("_first"), "_row"
    )
    own = F.collect_list(F.when(F.col("_first"), F.col("_row"))) if rest else F.count_if("_first")
    gathered = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("_pieces"), own.alias("_rows"))
    text = join_vocab_pieces(F.transform("_pieces", lambda p: p["t"]))
    # A key that is NULL names no row.
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    texts = gathered.select(*keys, F.when(named, text).alias(name), "_rows")
    back = texts.select(*keys, F.explode("_rows" if rest else F.array_repeat(F.lit(True), F.col("_rows").cast("int"))).alias("_row"), F.coalesce(name, F.lit("")).alias(name))
    return back.select(*keys, *[F.col("_row")[c].alias(c) for c in rest if c != name], name)


def resolve_part(spark: SparkSession, name: str, root: str) -> str:
    """Path of a corpus part: as given, under ``root``, under its ``corpus/parts`` folder,
    and there with the ``.jsonl`` suffix; the first that exists."""
    tries = [name]
    if not name.startswith("/") and "://" not in name:
        tries += [f"{root}/{name}", f"{root}/corpus/parts/{name}"]
        if not name.endswith(".jsonl"):
            tries.append(f"{root}/corpus/parts/{name}.jsonl")
    for path in tries:
        try:
            spark.read.format("text").load(path).schema  # noqa: B018
            return path
        except AnalysisException:
            continue
    raise FileNotFoundError(f"no such corpus part: {name}")


def part_name(path: str) -> str:
    """File name without folder and suffix."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_parts(spark: SparkSession, names: Sequence[str], root: str) -> list[tuple[str, DataFrame]]:
    """(name, part) of the corpus parts, each with ``row_no``, in the given order; parts of different
    folders may have one name."""
    paths = [resolve_part(spark, n, root) for n in names]
    return [(part_name(p), read_numbered_jsonl(spark, p, schemas.CORPUS_ROW).drop("file")) for p in paths]


def write_wrong_rows(graded: DataFrame, path: str) -> bool:
    """Write rows with ``correct`` false to their own folder, only if there are any."""
    wrong = graded.filter(~F.coalesce("correct", F.lit(False)))
    if wrong.isEmpty():
        return False
    wrong.write.mode("overwrite").parquet(path)
    return True
