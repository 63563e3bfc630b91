"""Expressions over a profile struct: missing fields, disclosure rules, counts, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions.text import is_blank, present, unless_empty


def no_rules() -> Column:
    return F.create_map().cast("map<string,string>")


def detect_missing(profile: Column) -> Column:
    """Required fields that are null or blank, in report order."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    is_blank(profile[name]),
                    F.struct(
                        F.lit(name).alias("field_name"),
                        F.lit(label).alias("label"),
                        F.lit(C.MISSING_REASON).alias("reason"),
                    ),
                )
                for name, label in C.REQUIRED_FIELDS.items()
            ]
        )
    )


def overlay_rules(base: Column, top: Column) -> Column:
    """Union of two rule maps in which `top` decides shared keys."""
    top = F.coalesce(top, no_rules())
    kept = F.map_filter(F.coalesce(base, no_rules()), lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def pending_rules(missing: Column) -> Column:
    """`pending_confirmation` for every missing field."""
    return F.map_from_entries(
        F.transform(
            missing,
            lambda m: F.struct(m["field_name"], F.lit(C.PENDING_CONFIRMATION)),
        )
    )


def _count_strings(value: Column, dtype: T.DataType) -> Column:
    """Number of non-blank strings below a value of the given type."""
    if isinstance(dtype, T.StructType):
        return reduce(
            lambda a, b: a + b, [_count_strings(value[f.name], f.dataType) for f in dtype.fields]
        )
    if isinstance(dtype, T.ArrayType):
        return F.aggregate(
            F.coalesce(value, F.array().cast(dtype)),
            F.lit(0),
            lambda n, item: n + _count_strings(item, dtype.elementType),
        )
    return F.when(is_blank(value), 0).otherwise(1)


def ledger(profile: Column) -> Column:
    """(extracted, placed, needs_review): populated leaves twice, then missing fields."""
    extracted = reduce(
        lambda a, b: a + b,
        [
            _count_strings(profile[f.name], f.dataType)
            for f in S.PROFILE.fields
            if f.name not in S.REVIEW_FIELDS
        ],
    )
    return F.struct(
        extracted.alias("extracted"),
        extracted.alias("placed"),
        F.size(profile["missing_fields"]).alias("needs_review"),
    )


def missing_labels(profile: Column) -> Column:
    return F.transform(profile["missing_fields"], lambda m: m["label"])


def _label_list(profile: Column) -> Column:
    return F.array_join(
        F.transform(missing_labels(profile), lambda label: F.concat(F.lit("- "), label)), "\n"
    )


def _name_or(profile: Column, other: str) -> Column:
    return F.coalesce(unless_empty(profile["full_name"]), F.lit(other))


def followup_message(profile: Column) -> Column:
    """Message to the candidate: thanks, or thanks and the list of open points."""
    opening = F.concat(F.lit("Hi "), _name_or(profile, "there"), F.lit(",\n\n"))
    closing = F.lit("\n\nBest,\n")
    return F.when(
        F.size(profile["missing_fields"]) == 0,
        F.concat(opening, F.lit(C.FOLLOWUP_COMPLETE), closing),
    ).otherwise(
        F.concat(
            opening, F.lit(C.FOLLOWUP_MISSING + "\n\n"), _label_list(profile), closing
        )
    )


def internal_summary(profile: Column) -> Column:
    """Short note for the recruiter."""
    return F.concat(
        F.lit("Candidate: "),
        _name_or(profile, "Unknown"),
        F.lit("\n\nMissing information:\n"),
        F.coalesce(unless_empty(_label_list(profile)), F.lit("- None")),
        F.lit("\n"),
    )


def field_display(profile: Column, field: str) -> Column:
    """What a client sees of one field under its disclosure rule (default: show)."""
    rule = F.try_element_at(profile["client_display_rules"], F.lit(field))
    return (
        F.when(rule == C.HIDE, F.lit(None).cast("string"))
        .when(rule == C.PENDING_CONFIRMATION, F.lit(C.PENDING_TEXT))
        .when(rule == C.AVAILABLE_UPON_REQUEST, F.lit(C.ON_REQUEST_TEXT))
        .otherwise(present(profile[field]))
    )
