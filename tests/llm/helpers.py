"""Small tables with the hard cases, and brute-force versions to compare with."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int, vocabulary: int = 500) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(40)}" for _ in range(n))


def frame(spark, texts: dict):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """Columns that an operator might use itself."""
    from pyspark.sql import functions as F

    names = ("score", "ids", "term", "rep", "bucket", "key", "row_id", "words", "component", "group")
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
