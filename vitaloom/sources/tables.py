"""Profiles, registry and run outputs as tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom import schemas as S
from vitaloom.operators.artifacts import not_yet_stored
from vitaloom.operators.blueprints import check_blueprints, duplicate_ids, registry


def write_profiles_json(profiles: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One JSON object per line with every key written, nulls included."""
    profiles.write.mode(mode).option("ignoreNullFields", "false").json(folder)


def read_profiles_json(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    schema = T.StructType(
        [T.StructField(key, T.StringType()), T.StructField("profile", S.PROFILE)]
    )
    return spark.read.schema(schema).json(folder)


def stored(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A parquet table with the given schema; no rows when nothing is written yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(df: DataFrame, folder: str, *keys: str) -> None:
    """Append the rows whose key the table does not hold: a stored original stays.

    Of several rows of one key in `df` one is written, the same whenever the rows are.
    """
    known = stored(df.sparkSession, folder, T.StructType([df.schema[k] for k in keys]))
    order = F.xxhash64(F.to_json(F.struct(*df.columns)))
    whole = F.struct(*df.columns)
    settled = df.groupBy(*keys).agg(F.min_by(whole, order).alias("_row")).select("_row.*")
    not_yet_stored(settled, known, *keys).write.mode("append").parquet(folder)


def write_process_outputs(processed: DataFrame, folder: str) -> None:
    """Originals of (artifact_id, text, profile): raw text, profile, missing fields.

    Extraction runs once; the outputs are written from the kept result.
    """
    kept = processed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        append_new(kept.select("artifact_id", "text"), f"{folder}/raw_text", "artifact_id")
        append_new(kept.select("artifact_id", "profile"), f"{folder}/profiles", "artifact_id")
        append_new(
            kept.select("artifact_id", F.col("profile.missing_fields").alias("missing_fields")),
            f"{folder}/missing_fields",
            "artifact_id",
        )
    finally:
        kept.unpersist()


def write_generate_outputs(generated: DataFrame, folder: str) -> None:
    """Export snapshots of (artifact_id, generation, text, profile, context, target_format).

    Snapshots get their own tables, keyed by generation; originals are left alone, and raw
    text is only written for artifacts that have none.
    """
    kept = generated.persist(StorageLevel.MEMORY_AND_DISK)
    key = ["artifact_id", "generation"]
    try:
        texts = kept.where(F.col("text").isNotNull())
        append_new(
            texts.groupBy("artifact_id").agg(F.min_by("text", "generation").alias("text")),
            f"{folder}/raw_text",
            "artifact_id",
        )
        append_new(kept.select(*key, "profile"), f"{folder}/export_snapshots", *key)
        append_new(
            kept.select(*key, F.col("profile.missing_fields").alias("missing_fields")),
            f"{folder}/export_missing_fields",
            *key,
        )
        append_new(kept.select(*key, "context"), f"{folder}/render_contexts", *key)
        append_new(
            kept.where(F.col("target_format").isNotNull()).select(*key, "target_format"),
            f"{folder}/target_formats",
            *key,
        )
    finally:
        kept.unpersist()


def load_blueprints(spark: SparkSession, folder: str) -> DataFrame:
    """Registry rows of `<folder>/*/blueprint.json`, checked.

    A rejected file or an id registered twice is an error, found before any use.
    """
    files = spark.read.text(f"{folder}/*/blueprint.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )
    checked = check_blueprints(files)
    bad = checked.where(F.size("violations") > 0).select("path", "violations").take(1)
    if bad:
        raise ValueError(f"invalid blueprint {bad[0].path}: {bad[0].violations}")
    registered = registry(checked)
    twice = duplicate_ids(registered).take(1)
    if twice:
        raise ValueError(f"Duplicate target format blueprint: {twice[0].template_id}")
    return registered
