"""Whole-corpus runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions import conform
from vitaloom.functions.remember import remembered
from vitaloom.functions.rules import ledger
from vitaloom.operators.blueprints import effective_template
from vitaloom.operators.extract import extract_profiles
from vitaloom.operators.layout import lay_out
from vitaloom.operators.render import with_context
from vitaloom.operators.validate import reject_empty_text
from vitaloom.templates import built_in_registry


NO_LINES = "no line was laid out"


def run_corpus(
    docs: DataFrame,
    *keep: str,
    blind: Column | bool = True,
    template: Column | str = C.DEFAULT_TEMPLATE,
    problem: str | None = None,
) -> DataFrame:
    """Every document from extraction to its lines; a failure is a `reason`, not a stop.

    The result has one row per input row: `profile`, `context` and `n_lines`, or `reason`. What
    the source says of a file it could not read (the column `problem`, if named), an empty text,
    a profile that breaks the strict schema, an unknown template and a layout without a line are
    failures, in this order. `template` may be a column of `keep`.
    """
    template = template if isinstance(template, Column) else F.lit(template)
    checked = reject_empty_text(docs)
    if problem is not None:
        checked = checked.withColumn("reason", F.coalesce(problem, "reason"))
    staged = extract_profiles(checked, *keep, "reason").withColumnRenamed("reason", "_empty")
    profiled = staged.withColumn("_payload", F.to_variant_object("profile")).withColumn(
        "_violations", F.array_join(_violations(), "; ")
    )
    asked = with_context(profiled, blind, template).withColumns(
        {"template_name": template, "_matched": F.lit(None).cast("string")}
    )
    chosen = effective_template(asked, built_in_registry(docs.sparkSession), "_matched")
    laid = lay_out(chosen).withColumn("n_lines", F.size("lines")).withColumn(
        "reason",
        F.coalesce(
            "_empty",
            F.nullif("_violations", F.lit("")),
            "reason",
            F.when(F.coalesce(F.col("n_lines"), F.lit(0)) <= 0, F.lit(NO_LINES)),
        ),
    )
    ok = F.col("reason").isNull()
    return laid.select(
        *keep, *[F.when(ok, F.col(c)).alias(c) for c in ("profile", "context", "n_lines")], "reason"
    )


@remembered
def _violations() -> Column:
    return conform.violations(F.col("_payload"), conform.PROFILE_SHAPE)


def failure_counts(run: DataFrame, *by: str) -> DataFrame:
    """Documents per outcome and the lines laid out for them; `reason` is null for the good ones."""
    lines = F.coalesce(F.sum("n_lines"), F.lit(0)).cast("long")
    return run.groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("documents"), lines.alias("lines")
    )


def missing_rates(profiles: DataFrame, by: str) -> DataFrame:
    """Completeness per group: documents, contacts found, and missing required fields.

    One pass with plain counters, no explode: the shuffle carries a row per task and group.
    """
    missing = F.transform(F.col("profile.missing_fields"), lambda m: m["field_name"])
    return profiles.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("profile.email").alias("with_email"),
        F.count("profile.phone").alias("with_phone"),
        *[
            F.count_if(F.array_contains(missing, name)).alias(f"missing_{name}")
            for name in C.REQUIRED_FIELDS
        ],
    )


def review_histogram(profiles: DataFrame) -> DataFrame:
    """Documents and mean number of extracted leaves per number of open fields."""
    counts = profiles.select(ledger(F.col("profile")).alias("ledger"))
    return counts.groupBy(F.col("ledger.needs_review").alias("needs_review")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("ledger.extracted").alias("mean_extracted"),
    )
