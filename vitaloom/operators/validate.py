"""Checks that yield a reason instead of an exception, and the good/rejected split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions import conform, nested
from vitaloom.functions.remember import remembered
from vitaloom.functions.text import is_blank
from vitaloom.operators.review import with_missing

NO_JSON = "response did not contain JSON"
BAD_JSON = "response held malformed JSON"
EMPTY_TEXT = "no extractable text"


def good(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows without a rejection reason."""
    return df.where(F.col(reason).isNull()).drop(reason)


def rejected(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Quarantine: rows with a rejection reason."""
    return df.where(F.col(reason).isNotNull())


def reject_empty_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `reason`, set where nothing but white space was extracted."""
    return docs.withColumn("reason", F.when(is_blank(F.col(text)), F.lit(EMPTY_TEXT)))


def parse_payloads(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds `payload` (VARIANT) and `reason`.

    A response that is no JSON as a whole is searched for the span from its first opening
    to its last closing brace.
    """
    return (
        responses.withColumn("_whole", conform.parse_json(F.col(raw)))
        .withColumn("_span", F.when(
            F.col("_whole").isNull(), F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0)
        ))
        .withColumn("payload", F.coalesce("_whole", conform.parse_json(F.col("_span"))))
        .withColumn(
            "reason",
            F.when(F.col("payload").isNotNull(), F.lit(None).cast("string"))
            .when(F.coalesce(F.col("_span"), F.lit("")) == "", F.lit(NO_JSON))
            .otherwise(F.lit(BAD_JSON)),
        )
        .drop("_whole", "_span")
    )


def conform_profiles(parsed: DataFrame) -> DataFrame:
    """Replaces `payload` by `violations`, `profile` and an updated `reason`.

    One violation anywhere rejects the document; a conforming payload becomes a profile
    with trimmed strings and missing fields applied.
    """
    typed = F.try_variant_get(F.col("payload"), "$", S.PROFILE.simpleString())
    typed_rows = (
        parsed.withColumn(
            "violations",
            F.when(
                F.col("payload").isNotNull(),
                _profile_violations(),
            ).otherwise(F.array().cast("array<string>")),
        )
        .withColumn(
            "reason",
            F.coalesce(
                F.col("reason"),
                F.when(F.size("violations") > 0, F.array_join("violations", "; ")),
            ),
        )
        .withColumn("_typed", F.when(F.col("reason").isNull(), typed))
        .drop("payload")
        .withColumn("profile", _tidy_profile())
        .drop("_typed")
    )
    ok = F.col("reason").isNull()
    return with_missing(typed_rows).withColumn("profile", F.when(ok, F.col("profile")))


@remembered
def _profile_violations() -> Column:
    return conform.violations(F.col("payload"), conform.PROFILE_SHAPE)


@remembered
def _tidy_profile() -> Column:
    return nested.tidy(F.col("_typed"), S.PROFILE)


def is_safe_artifact_id(artifact_id: Column) -> Column:
    """Non-empty and only letters, numbers, `_` and `-`; `\\z` also rejects a final newline."""
    return F.coalesce(
        F.rlike(artifact_id, F.lit(r"^[\p{L}\p{N}_-]+\z")), F.lit(False)
    )


def is_downloadable(filename: Column) -> Column:
    return filename.isin(*C.DOWNLOADABLE_FILES)


def suffix(filename: Column) -> Column:
    """Lower-case file suffix with its dot; '' without one or for a bare dot file."""
    return F.lower(F.regexp_extract(filename, r"(?s)[^./][^/]*(\.[^./]+)\z", 1))


def is_accepted_upload(filename: Column) -> Column:
    return suffix(filename).isin(*C.ACCEPTED_SUFFIXES)
