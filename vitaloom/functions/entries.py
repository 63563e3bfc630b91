"""Structured entries read from the trimmed lines of one section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions.text import (
    cut_once,
    date_range,
    marked_items,
    strip,
    unless_empty,
    unmarked,
)


def _nothing() -> Column:
    return F.lit(None).cast("string")


POSITION_PATTERN = (
    rf"(?iud)^(.+?)[{C.SPACE}]+at[{C.SPACE}]+(.+?)(?:[{C.SPACE}]*\(([^)]+)\))?$"
)


def position(line: Column) -> Column:
    """(title, company, start_date, end_date) of a line like `Title at Company (dates)`.

    A line of another shape is taken as the title.
    """
    shaped = F.rlike(line, F.lit(POSITION_PATTERN))
    dates = date_range(F.regexp_extract(line, POSITION_PATTERN, 3))
    return F.struct(
        F.when(shaped, strip(F.regexp_extract(line, POSITION_PATTERN, 1)))
        .otherwise(unless_empty(line))
        .alias("title"),
        F.when(shaped, strip(F.regexp_extract(line, POSITION_PATTERN, 2))).alias("company"),
        dates["start_date"].alias("start_date"),
        dates["end_date"].alias("end_date"),
    )


def experience_entries(lines: Column, projects: Column, achievements: Column) -> Column:
    """At most one work-experience entry: its first line names the position, everything
    else, projects and achievements included, describes it."""
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), unmarked)
    described = F.concat(
        rest,
        F.transform(marked_items(projects), lambda x: F.concat(F.lit("Project: "), x)),
        F.transform(marked_items(achievements), lambda x: F.concat(F.lit("Achievement: "), x)),
    )

    def entry(line: Column) -> Column:
        head = position(unmarked(line))
        return F.struct(
            head["company"].alias("company"),
            head["title"].alias("title"),
            _nothing().alias("location"),
            head["start_date"].alias("start_date"),
            head["end_date"].alias("end_date"),
            F.filter(described, lambda x: x != "").alias("description"),
        )

    return F.transform(F.slice(lines, 1, 1), entry)


def education_entry(value: Column) -> Column:
    """`Degree – Institution (date)`; the date and the institution are optional."""
    # No `$` trick is needed for line ends: a section line never contains one.
    dated = rf"\(([^)]+)\)[{C.SPACE}]*$"
    undated = strip(
        F.regexp_replace(value, rf"[{C.SPACE}]*\([^)]+\)[{C.SPACE}]*$", "")
    )
    parts = cut_once(undated, rf"[{C.SPACE}]+[–—-][{C.SPACE}]+")
    return F.struct(
        parts["tail"].alias("institution"),
        unless_empty(parts["head"]).alias("degree"),
        _nothing().alias("field_of_study"),
        _nothing().alias("start_date"),
        F.when(
            F.rlike(value, F.lit(dated)), strip(F.regexp_extract(value, dated, 1))
        ).alias("end_date"),
    )


def _solid(lines: Column) -> Column:
    return F.filter(F.transform(lines, unmarked), lambda line: line != "")


def education_entries(lines: Column) -> Column:
    return F.transform(_solid(lines), education_entry)


def certification_entries(lines: Column) -> Column:
    return F.transform(
        _solid(lines),
        lambda line: F.struct(
            line.alias("name"), _nothing().alias("issuer"), _nothing().alias("date")
        ),
    )


def language_entries(names: Column) -> Column:
    return F.transform(
        names, lambda name: F.struct(name.alias("name"), _nothing().alias("proficiency"))
    )
