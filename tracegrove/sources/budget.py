"""Corpus parts kept as files, merged under a token budget without reading what lies behind it.

A merge stops at the first row that exceeds the budget, so files wholly behind it need not be opened. Sizes are
summed file by file first, for 1, 2, 4, ... files from the front until the budget is passed; then rows are
decided on, in the files up to the one that passes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mixing import flag_merge, merge_corpus, source_name
from .files import files

#: Rows are in the order of the parts, of the file names in a part, and of the rows in a file.
FILE_ORDER = ["part_index", "file_no", "row_no"]


def part_files(spark: SparkSession, parts: Sequence[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(part index, part name, file) of all files of Parquet parts (name, path), in order."""
    return [(i, name, f) for i, (name, path) in enumerate(parts) for f, _ in files(spark, path)]


def read_files(spark: SparkSession, listed: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Corpus rows of Parquet files with part, part_index, source, file_no and row_no."""
    numbers = {f: k for k, (_, _, f) in enumerate(listed)}
    by_part: dict[tuple[int, str], list[str]] = {}
    for i, name, f in listed:
        by_part.setdefault((i, name), []).append(f)

    def one(i: int, name: str, paths: list[str]) -> DataFrame:
        names = F.create_map(*[F.lit(x) for f in paths for x in (f.rsplit("/", 1)[1], numbers[f])])
        rows = spark.read.parquet(*paths)
        return rows.drop("row_no").select(
            "*",
            F.lit(name).alias("part"),
            F.lit(i).alias("part_index"),
            F.element_at(names, F.col("_metadata.file_name")).alias("file_no"),
            F.col("_metadata.row_index").alias("row_no"),
        )

    merged = reduce(DataFrame.unionByName, [one(i, name, paths) for (i, name), paths in by_part.items()])
    return merged.withColumn("source", source_name(F.col("part")))


def _amounts(spark: SparkSession, listed: Sequence[tuple[int, str, str]], options: dict) -> list[int]:
    """Tokens of the rows each file would emit if there were no budget."""
    flagged = flag_merge(read_files(spark, listed), order=FILE_ORDER, **options).filter("emitted")
    sums = dict(map(tuple, flagged.groupBy("file_no").agg(F.sum("n_tokens")).collect()))
    return [sums.get(k, 0) for k in range(len(listed))]


def files_within(spark: SparkSession, listed: Sequence[tuple[int, str, str]], max_tokens: int, **options) -> list[tuple[int, str, str]]:
    """The files a merge under a budget has to read. What a file emits depends on earlier ones only."""
    if max_tokens <= 0:
        return list(listed)
    n = 1
    while True:
        some = listed[:n]
        total = 0
        for k, amount in enumerate(_amounts(spark, some, options)):
            total += amount
            if total > max_tokens:
                return list(some[: k + 1])
        if n >= len(listed):
            return list(listed)
        n *= 2


def merge_files(spark: SparkSession, parts: Sequence[tuple[str, str]], max_tokens: int = 0, **options) -> DataFrame:
    """:func:`..operators.mixing.merge_corpus` of Parquet parts (name, path), reading no file behind the budget.

    ``options`` are those of :func:`..operators.mixing.flag_merge`.
    """
    listed = files_within(spark, part_files(spark, parts), max_tokens, **options)
    return merge_corpus(read_files(spark, listed), order=FILE_ORDER, max_tokens=max_tokens, **options)


def written_in_order(df: DataFrame, path: str, order: str, n_files: int) -> None:
    """A part as ``n_files`` Parquet files whose names and rows follow ``order``."""
    df.repartitionByRange(n_files, order).sortWithinPartitions(order).write.parquet(path)
