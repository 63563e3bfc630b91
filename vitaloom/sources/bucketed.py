"""Tables stored in buckets by a key, so that joins on it need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, table: str, folder: str, key: str, buckets: int) -> DataFrame:
    """Writes `df` as the table `table` at `folder`: one sorted file a bucket; returns it.

    A table of that name that exists already is an error.
    """
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", folder)
        .saveAsTable(table)
    )
    return read_bucketed(df.sparkSession, table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
