"""Tables kept for reuse: partitioned by what filters name, bucketed by the id that joins meet on.

A filter on the partition column reads those folders only, and two tables bucketed alike by an id are joined,
aggregated and deduplicated by it without moving a row. Bucket counts live in the session's catalog, not in the
files, so :func:`open_table` tells a new session about a table that another one wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table; joins without an exchange need the same number on both sides.
BUCKETS = 64


def write_bucketed(
    df: DataFrame, name: str, path: str, bucket_by: Sequence[str], partition_by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """Keep ``df`` as Parquet below ``path``, known to the session as ``name``; the table.

    Rows are dealt by the bucket columns before the write, so that each bucket of a partition is one file, and
    sorted by them inside it.
    """
    writer = df.repartition(buckets, *bucket_by).write.mode("overwrite").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).saveAsTable(name)
    return df.sparkSession.table(name)


def open_table(
    spark: SparkSession, name: str, path: str, schema: str, bucket_by: Sequence[str], partition_by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """A table another session wrote by :func:`write_bucketed`; ``schema`` as DDL with all columns."""
    ids = ", ".join(f"`{c}`" for c in bucket_by)
    parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {parts} CLUSTERED BY ({ids}) SORTED BY ({ids}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partition_by:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
