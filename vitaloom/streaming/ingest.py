"""New documents as a stream: the batch extraction on a streaming source.

Extraction keeps no state between documents, so the same expressions run unchanged and a
micro-batch needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaloom.operators.extract import extract_profiles
from vitaloom.operators.validate import reject_empty_text
from vitaloom.session import checkpoint_for
from vitaloom.sources.files import BINARY_FILE, docx_text, is_resume_file


def stream_texts(
    spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a text table as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def stream_docx(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text, error_type, error) of DOCX files as they arrive."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return docx_text(files.where(is_resume_file(F.col("path"))))


def profiles_of(texts: DataFrame, *keep: str) -> DataFrame:
    """Profiles with `reason` set where a text was empty; batch or stream."""
    return extract_profiles(reject_empty_text(texts), *keep, "reason")


def start_profile_sink(
    texts: DataFrame, folder: str, *keep: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Append profiles to a parquet table; drains what is there, then stops."""
    where = checkpoint or checkpoint_for(texts.sparkSession, "profiles", folder)
    return (
        profiles_of(texts, *keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", where)
        .trigger(availableNow=True)
        .start()
    )
