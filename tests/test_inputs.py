"""Inputs derived from the test tables lie in enough partitions, whatever their files are."""

import os

import pytest
from pyspark.sql import functions as F

from vitaloom.plans import inputs
from vitaloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one_file(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_a_small_file_of_many_rows_is_no_single_task(spark, tmp_path):
    customers = spark.range(4000).select(
        F.col("id").alias("c_custkey"),
        F.concat(F.lit("Customer "), "id").alias("c_name"),
        (F.col("id") % 3).alias("c_nationkey"),
        F.lit("AUTOMOBILE").alias("c_mktsegment"),
    )
    nations = spark.range(3).selectExpr("id AS n_nationkey", "concat('Nation ', id) AS n_name")
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "'en' AS lang", "'s' AS source", "'one line' AS text", "8L AS n_chars"
    )
    for name, df in {"customer": customers, "nation": nations, "documents": docs}.items():
        one_file(df, tmp_path, name)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for derived in (inputs.customer_resumes, inputs.payloads, inputs.document_resumes):
        rows = derived(spark, str(tmp_path))
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == wanted > 1
        assert sum(s["count"] for s in sizes) == 4000
        assert max(s["count"] for s in sizes) < 2000
        assert rows.select("doc_id").distinct().count() == 4000


def test_tables_that_lie_in_enough_partitions_are_not_shuffled(spark):
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100, numPartitions=wanted)
    assert inputs.spread(rows, "id") is rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_edited_profiles_are_extracted_once(spark):
    read = QUERIES["apply_edits"](spark, SF).inputFiles()
    assert read and not any("customer.parquet" in f for f in read)
