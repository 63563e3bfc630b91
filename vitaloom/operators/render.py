"""Profile -> what a client may see: one projection, the profile itself is untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions.remember import remembered
from vitaloom.functions.rules import field_display
from vitaloom.functions.text import is_blank, join_present, present


def heading(profile: Column, blind: Column) -> Column:
    return F.when(blind, F.lit(C.BLIND_HEADING)).otherwise(
        F.coalesce(present(profile["full_name"]), F.lit(C.NAMELESS_HEADING))
    )


def subheading(profile: Column) -> Column:
    """Current title and displayed location."""
    return join_present(
        [F.get(profile["work_experience"], 0)["title"], field_display(profile, "location")]
    )


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def contact_lines(profile: Column, blind: Column) -> Column:
    """Location first; the direct contacts unless blind.

    A blind profile shows its portfolio only under an explicit `show` rule.
    """
    shows_portfolio = (
        F.try_element_at(profile["client_display_rules"], F.lit("portfolio_url")) == C.SHOW
    )
    lines = [_labelled("Location", field_display(profile, "location"))]
    for field, label in C.CONTACT_LABELS.items():
        open_to_client = ~blind | shows_portfolio if field == "portfolio_url" else ~blind
        lines.append(F.when(open_to_client, _labelled(label, field_display(profile, field))))
    return F.array_compact(F.array(*lines))


def language_lines(profile: Column) -> Column:
    return F.array_compact(
        F.transform(
            profile["languages"], lambda x: join_present([x["name"], x["proficiency"]])
        )
    )


def _solid_items(items: Column) -> Column:
    return F.filter(items, lambda item: ~is_blank(item))


def _dates(entry: Column) -> Column:
    return join_present([entry["start_date"], entry["end_date"]], " - ")


def experience(profile: Column) -> Column:
    return F.transform(
        profile["work_experience"],
        lambda x: F.struct(
            present(x["company"]).alias("company"),
            present(x["title"]).alias("title"),
            present(x["location"]).alias("location"),
            _dates(x).alias("date_range"),
            _solid_items(x["description"]).alias("description"),
        ),
    )


def education(profile: Column) -> Column:
    return F.transform(
        profile["education"],
        lambda x: F.struct(
            present(x["institution"]).alias("institution"),
            present(x["degree"]).alias("degree"),
            present(x["field_of_study"]).alias("field_of_study"),
            _dates(x).alias("date_range"),
        ),
    )


def certification_lines(profile: Column) -> Column:
    return F.array_compact(
        F.transform(
            profile["certifications"],
            lambda x: join_present([x["name"], x["issuer"], x["date"]]),
        )
    )


def additional_details(profile: Column) -> Column:
    details = [
        F.struct(F.lit(label).alias("label"), field_display(profile, field).alias("value"))
        for field, label in C.DETAIL_LABELS.items()
    ]
    return F.filter(F.array(*details), lambda d: d["value"].isNotNull())


def render_context(
    profile: Column, blind: Column | bool = False, template: Column | str = C.DEFAULT_TEMPLATE
) -> Column:
    """The whole client-facing context of a profile as one struct."""
    blind, template = _column(blind), _column(template)
    return F.struct(
        template.alias("template_name"),
        heading(profile, blind).alias("candidate_heading"),
        subheading(profile).alias("candidate_subheading"),
        contact_lines(profile, blind).alias("contact_lines"),
        present(profile["professional_summary"]).alias("professional_summary"),
        _solid_items(profile["skills"]).alias("skills"),
        language_lines(profile).alias("languages"),
        experience(profile).alias("work_experience"),
        education(profile).alias("education"),
        certification_lines(profile).alias("certifications"),
        additional_details(profile).alias("additional_details"),
        blind.alias("blind_profile"),
    )


def with_context(
    profiles: DataFrame, blind: Column | bool = False, template: Column | str = C.DEFAULT_TEMPLATE
) -> DataFrame:
    """Adds `context`; no shuffle, no UDF."""
    parts = profiles.withColumn("_blind", F.coalesce(_column(blind), F.lit(False))).withColumn(
        "_template", _column(template)
    )
    return parts.withColumn("context", _context()).drop("_blind", "_template")


@remembered
def _context() -> Column:
    return render_context(F.col("profile"), F.col("_blind"), F.col("_template"))


def _column(value: Column | bool | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
