"""Strict shape checks of a JSON value held as VARIANT, one reason per violation.

A shape is declared once (`Text`, `Number`, `Flag`, `ListOf`, `MapOf`, `Record`) and turned
into one expression: an array of `path: reason` strings, empty when the value conforms.
Unlike `from_json`, this rejects unknown keys and never turns a number into a string.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions.text import no_strings, strip

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Shape:
    required: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Text(Shape):
    # (test on the trimmed string, reason when it fails)
    checks: tuple[tuple[Check, str], ...] = ()
    # The only values there may be, if any are named.
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Number(Shape):
    whole: bool = False
    checks: tuple[tuple[Check, str], ...] = ()


@dataclass(frozen=True)
class Flag(Shape):
    pass


@dataclass(frozen=True)
class ListOf(Shape):
    item: Shape = field(default_factory=Text)


@dataclass(frozen=True)
class MapOf(Shape):
    value: Shape = field(default_factory=Text)
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Record(Shape):
    fields: dict[str, Shape] = field(default_factory=dict)


def one_of(values: tuple[str, ...]) -> tuple[str, ...]:
    """Allowed values of a text, compared as it is written, outer blanks included."""
    return values


def matching(pattern: str, reason: str) -> tuple[tuple[Check, str], ...]:
    return ((lambda v: F.rlike(v, F.lit(pattern)), reason),)


def parse_json(raw: Column) -> Column:
    """The text as VARIANT when all of it is one JSON value, else null.

    The parser stops after the first value, so the text is parsed as the first of two list
    items; the second, a hash of the text, shows that nothing but the value was read.
    """
    seal = F.xxhash64(raw).cast("string")
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), seal, F.lit('"]'))),
        "$",
        "array<variant>",
    )
    sealed = (F.size(items) == 2) & (
        F.try_variant_get(F.get(items, 1), "$", "string") == seal
    )
    return F.when(sealed, F.get(items, 0))


def _found(path: Column, reason: str) -> Column:
    return F.array(F.concat(path, F.lit(": " + reason)))


def _if_type(value: Column, accepted: Column, path: Column, kind: str, inner: Column) -> Column:
    return F.when(accepted, inner).otherwise(_found(path, f"not {kind}"))


def _run_checks(value: Column, checks: tuple, path: Column) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.coalesce(test(value), F.lit(False)),
                    F.concat(path, F.lit(": " + reason)),
                )
                for test, reason in checks
            ]
        )
    ) if checks else no_strings()


def _violations(value: Column, shape: Shape, path: Column) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(shape, Text):
        text = strip(F.try_variant_get(value, "$", "string"))
        found = _run_checks(text, shape.checks, path)
        if shape.allowed:
            raw = F.try_variant_get(value, "$", "string")
            exact = ((lambda v: v.isin(*shape.allowed), "not an allowed value"),)
            found = F.concat(_run_checks(raw, exact, path), found)
        body = _if_type(value, kind == "STRING", path, "a string", found)
    elif isinstance(shape, Flag):
        body = _if_type(value, kind == "BOOLEAN", path, "a boolean", no_strings())
    elif isinstance(shape, Number):
        numeric = kind == "BIGINT" if shape.whole else F.rlike(
            kind, F.lit(r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$")
        )
        number = F.try_variant_get(value, "$", "double")
        body = _if_type(
            value,
            numeric,
            path,
            "a whole number" if shape.whole else "a number",
            _run_checks(number, shape.checks, path),
        )
    elif isinstance(shape, ListOf):
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.flatten(
            F.transform(
                items,
                lambda item, i: _violations(
                    item, shape.item, F.concat(path, F.lit("."), i.cast("string"))
                ),
            )
        )
        body = _if_type(value, items.isNotNull(), path, "a list", inner)
    elif isinstance(shape, MapOf):
        entries = F.try_variant_get(value, "$", "map<string,variant>")
        inner = F.flatten(
            F.transform(
                F.map_entries(entries),
                lambda e: _violations(
                    e["value"], shape.value, F.concat(path, F.lit("."), e["key"])
                ),
            )
        )
        if shape.needs:
            needed = F.array(*[F.lit(n) for n in shape.needs])
            inner = F.concat(
                F.transform(
                    F.array_except(needed, F.map_keys(entries)),
                    lambda k: F.concat(path, F.lit("."), k, F.lit(": required")),
                ),
                inner,
            )
        body = _if_type(value, entries.isNotNull(), path, "an object", inner)
    else:
        entries = F.try_variant_get(value, "$", "map<string,variant>")
        body = _if_type(
            value, entries.isNotNull(), path, "an object", _record(entries, shape, path)
        )
    if shape.nullable:
        return F.when(F.is_variant_null(value), no_strings()).otherwise(body)
    return body


def _below(path: Column | None, key: Column) -> Column:
    return key if path is None else F.concat(path, F.lit("."), key)


def _record(entries: Column, shape: Record, path: Column | None) -> Column:
    known = F.array(*[F.lit(name) for name in shape.fields])
    unknown = F.transform(
        F.array_sort(F.array_except(F.map_keys(entries), known)),
        lambda k: F.concat(_below(path, k), F.lit(": unknown key")),
    )
    parts = [unknown]
    for name, sub in shape.fields.items():
        value = F.try_element_at(entries, F.lit(name))
        here = _below(path, F.lit(name))
        absent = _found(here, "required") if sub.required else no_strings()
        parts.append(
            F.when(F.map_contains_key(entries, name), _violations(value, sub, here)).otherwise(
                absent
            )
        )
    return F.concat(*parts)


def violations(value: Column, shape: Record) -> Column:
    """All violations of a record, in the order of its declared fields."""
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    return F.when(entries.isNull(), F.array(F.lit("payload: not an object"))).otherwise(
        _record(entries, shape, None)
    )


OPTIONAL_TEXT = Text(nullable=True)
HTTP_URL = Text(
    nullable=True,
    checks=matching(rf"(?i)^https?://[^{C.SPACE}/?#]+([/?#][^{C.SPACE}]*)?$", "not an http(s) URL"),
)

PROFILE_SHAPE = Record(
    fields={
        "full_name": OPTIONAL_TEXT,
        "email": OPTIONAL_TEXT,
        "phone": OPTIONAL_TEXT,
        "location": OPTIONAL_TEXT,
        "linkedin_url": HTTP_URL,
        "portfolio_url": HTTP_URL,
        "professional_summary": OPTIONAL_TEXT,
        "skills": ListOf(item=Text()),
        "languages": ListOf(
            item=Record(fields={"name": Text(required=True), "proficiency": OPTIONAL_TEXT})
        ),
        "work_experience": ListOf(
            item=Record(
                fields={
                    "company": OPTIONAL_TEXT,
                    "title": OPTIONAL_TEXT,
                    "location": OPTIONAL_TEXT,
                    "start_date": OPTIONAL_TEXT,
                    "end_date": OPTIONAL_TEXT,
                    "description": ListOf(item=Text()),
                }
            )
        ),
        "education": ListOf(
            item=Record(
                fields={
                    "institution": OPTIONAL_TEXT,
                    "degree": OPTIONAL_TEXT,
                    "field_of_study": OPTIONAL_TEXT,
                    "start_date": OPTIONAL_TEXT,
                    "end_date": OPTIONAL_TEXT,
                }
            )
        ),
        "certifications": ListOf(
            item=Record(
                fields={
                    "name": Text(required=True),
                    "issuer": OPTIONAL_TEXT,
                    "date": OPTIONAL_TEXT,
                }
            )
        ),
        "salary_expectation": OPTIONAL_TEXT,
        "notice_period": OPTIONAL_TEXT,
        "work_authorization": OPTIONAL_TEXT,
        "interview_availability": OPTIONAL_TEXT,
        "missing_fields": ListOf(
            item=Record(
                fields={
                    "field_name": Text(required=True),
                    "label": Text(required=True),
                    "reason": Text(required=True),
                }
            )
        ),
        "client_display_rules": MapOf(value=Text(allowed=one_of(C.DISPLAY_RULES))),
    }
)

_POSITIVE = ((lambda v: v > 0, "must be positive"),)
_NOT_NEGATIVE = ((lambda v: v >= 0, "must not be negative"),)
_SIZE = Number(required=True, checks=_POSITIVE)
_DISTANCE = Number(required=True, checks=_NOT_NEGATIVE)
_FLAG = Flag(required=True)
_TEXT = Text(required=True)

BLUEPRINT_SHAPE = Record(
    fields={
        "template_id": Text(
            required=True, checks=matching(r"^[a-z0-9][a-z0-9_-]+$", "not a template id")
        ),
        "version": Number(
            required=True, whole=True, checks=((lambda v: v >= 1, "must be at least 1"),)
        ),
        "display_name": _TEXT,
        "source_reference_type": Text(required=True, allowed=one_of(C.SOURCE_TYPES)),
        "source_sha256": ListOf(
            item=Text(checks=matching(r"^[0-9a-f]{64}$", "not a lower-case SHA-256"))
        ),
        "renderer_key": Text(required=True, allowed=one_of(C.RENDERER_KEYS)),
        "page": Record(
            required=True,
            fields={
                "width_inches": _SIZE,
                "height_inches": _SIZE,
                "top_margin_inches": _DISTANCE,
                "right_margin_inches": _DISTANCE,
                "bottom_margin_inches": _DISTANCE,
                "left_margin_inches": _DISTANCE,
                "header_distance_inches": _DISTANCE,
                "footer_distance_inches": _DISTANCE,
            },
        ),
        "typography": MapOf(
            required=True,
            needs=C.TYPOGRAPHY_ROLES,
            value=Record(
                fields={
                    "font_name": _TEXT,
                    "size_pt": _SIZE,
                    "bold": Flag(),
                    "italic": Flag(),
                    "color_hex": Text(
                        checks=matching(r"^#?[0-9A-Fa-f]{6}$", "not six hex digits")
                    ),
                    "line_spacing": _SIZE,
                    "space_before_pt": _DISTANCE,
                    "space_after_pt": _DISTANCE,
                }
            ),
        ),
        "section_order": ListOf(
            required=True, item=Text(allowed=one_of(C.BLUEPRINT_SECTIONS))
        ),
        "field_mappings": MapOf(required=True, value=Text()),
        "skills_columns": Number(
            required=True,
            whole=True,
            checks=((lambda v: (v >= 1) & (v <= 4), "must be between 1 and 4"),),
        ),
        "bullet_left_indent_inches": _DISTANCE,
        "bullet_hanging_indent_inches": _DISTANCE,
        "overflow": Record(
            required=True,
            fields={
                "allow_automatic_page_breaks": _FLAG,
                "keep_experience_heading_with_first_bullet": _FLAG,
                "keep_section_heading_with_next": _FLAG,
                "widow_control": _FLAG,
                "split_long_experience_entries": _FLAG,
            },
        ),
    }
)
