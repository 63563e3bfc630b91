"""Missing fields and disclosure rules of whole profile tables.

The steps are separate projections: each value is computed once, where one nested
expression would repeat the profile it starts from at every reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.functions import rules
from vitaloom.functions.remember import remembered


def with_missing(profiles: DataFrame) -> DataFrame:
    """Missing fields of `profile` detected anew and their default rules set.

    An explicit rule stays, and so does the rule of a field that has been filled since.
    """
    missing, with_defaults, updated = _missing_steps()
    return (
        profiles.withColumn("_missing", missing)
        .withColumn("_rules", with_defaults)
        .withColumn("profile", updated)
        .drop("_missing", "_rules")
    )


@remembered
def _missing_steps() -> tuple[Column, Column, Column]:
    p = F.col("profile")
    return (
        rules.detect_missing(p),
        rules.overlay_rules(rules.pending_rules(F.col("_missing")), p["client_display_rules"]),
        p.withField("missing_fields", F.col("_missing")).withField(
            "client_display_rules", F.col("_rules")
        ),
    )


def with_requested_rules(profiles: DataFrame, requested: str = "requested") -> DataFrame:
    """Rules sent with a request win over stored ones; then missing fields are re-detected."""
    p = F.col("profile")
    merged = rules.overlay_rules(p["client_display_rules"], F.col(requested))
    return with_missing(
        profiles.withColumn("profile", p.withField("client_display_rules", merged))
    )


def normalized(profiles: DataFrame) -> DataFrame:
    """Empty and repeated skills dropped (the first occurrence stays), missing re-detected."""
    p = F.col("profile")
    skills = F.array_distinct(F.filter(p["skills"], lambda s: s != ""))
    return with_missing(profiles.withColumn("profile", p.withField("skills", skills)))
