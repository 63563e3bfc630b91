"""A training corpus out of raw documents: five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm import bpe, decontaminate, minhash, quality, substrings
from vitaloom.llm.common import stored
from vitaloom.plans.inputs import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut.

    Each row is judged by its own text: null and empty texts get the score of the intercept,
    rows without an id or with a repeated one are rows like others. No row in, no row out.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs, weights)
    return scored.where(F.col("score") >= quality.CUT).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates.

    Of rows that repeat an id each is judged by its own text, and one of equal rows stays. Rows
    without an id or without words are compared with nothing and stay. No row in, no row out.
    """
    return minhash.distinct_rows(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat one of an earlier document; a document of
    which nothing but blanks is left goes.

    Null, empty and short texts and rows without an id stay as they are; passages are cut from
    the text they were found in, not from others of the same id. No row in, no row out.
    """
    passages = stored(substrings.near_duplicate_passages(docs), "passages")
    cut = substrings.remove_passages(docs.withColumn("_blank", _blank("text")), passages)
    return (
        cut.where(F.col("_blank") | ~_blank("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*docs.columns)
    )


def _blank(text: str) -> Column:
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.trim(plain) == ""


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark.

    Rows are told apart by id and text, so that a row without an id goes by its own text, and
    none goes for another one of its id. Null and empty texts hold nothing and stay; without
    benchmark items all rows stay. No row in, no row out.
    """
    row = F.concat_ws("/", F.col("doc_id"), F.xxhash64(F.col("text")))
    keyed = docs.withColumn("_row_of_stage", row)
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), "_row_of_stage")
    hit = found.where("contaminated").select(F.col("doc_id").alias("_row_of_stage")).distinct()
    return keyed.join(hit, "_row_of_stage", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digests of ids and of the decoded text.

    A null text is encoded as an empty one; ids of rows do not matter. No row in, no row out.
    """
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", distinct_documents),
    ("substring dedup", distinct_passages),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# No stage but decontamination can be told in SQL: tests hold the rows against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
