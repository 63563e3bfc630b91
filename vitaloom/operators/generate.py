"""From requests to exports: one chain over stored profiles, edits and uploaded target formats.

A request names an artifact, rules of its own, whether the profile is blind, a template and,
where a target format was uploaded, the record of it. It ends as the lines of its document or
as the reason for which it is refused. Profiles and formats are stored in buckets by artifact
(`sources.bucketed`), so neither is shuffled; edits and requests are, to the same buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.operators import blueprints, edits as ed, layout, render, review

NO_PROFILE = "The artifact has no stored profile."


def with_edits(profiles: DataFrame, edits: DataFrame, buckets: int | None = None) -> DataFrame:
    """Profiles with the edits that apply, and `open_fields`: the missing fields (by name) that
    no edit has filled.

    `buckets`: how many the profiles are stored in; edits then come to the profiles.
    """
    names = lambda missing: F.transform(missing, lambda m: m["field_name"])
    before = profiles.withColumn("_open_before", names(F.col("profile.missing_fields")))
    edited = ed.apply_edits(before, edits, buckets)
    return (
        review.with_missing(edited)
        .withColumn("open_fields", F.array_intersect("_open_before", names(F.col("profile.missing_fields"))))
        .drop("_open_before")
    )


def exports(
    requests: DataFrame,
    profiles: DataFrame,
    edits: DataFrame,
    formats: DataFrame,
    registered: DataFrame,
    buckets: int | None = None,
) -> DataFrame:
    """`requests` with template_id, open_fields, profile, context, lines and reason.

    requests: request_id, artifact_id, requested (map of rules), blind, template_name,
    target_format. profiles: artifact_id (unique), profile. edits: artifact_id, path, value,
    seq. formats: as `blueprints.check_references` takes them. registered: unique templates.

    A request without an artifact_id takes that of its target format. Reasons, the first that
    holds: ids that differ, an artifact without a profile, an unknown template, a target format
    that is not the uploaded one. A refused request has no lines. Every request is one row.
    """
    own = requests.withColumn(
        "artifact_id",
        F.coalesce(
            F.nullif("artifact_id", F.lit("")), F.nullif("target_format.artifact_id", F.lit(""))
        ),
    )
    if buckets is not None:
        own = own.repartition(buckets, "artifact_id")
    checked = blueprints.check_references(own, formats).withColumnRenamed("reason", "_sent")
    stored = with_edits(profiles.select("artifact_id", "profile"), edits, buckets)
    found = checked.join(stored, "artifact_id", "left")
    reviewed = review.with_requested_rules(found).withColumn(
        "matched_template_id", F.col("target_format.matched_template_id")
    )
    chosen = blueprints.effective_template(reviewed, registered).withColumnRenamed(
        "reason", "_unknown"
    )
    reason = (
        F.when(F.col("_sent") == C.REF_ID_MISMATCH, F.col("_sent"))
        .when(F.col("open_fields").isNull(), F.lit(NO_PROFILE))
        .otherwise(F.coalesce("_unknown", "_sent"))
    )
    rendered = render.with_context(chosen, F.col("blind"), F.col("template_id"))
    laid = layout.lay_out(rendered.withColumn("reason", reason))
    return laid.withColumn("lines", F.when(F.col("reason").isNull(), F.col("lines"))).drop(
        "_sent", "_unknown", "matched_template_id"
    )
