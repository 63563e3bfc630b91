"""Render context -> ordered document lines: which text stands where.

Every layout builds one array per document, so laying out a corpus needs no shuffle. A line
is (section, kind, text); `positions` turns the arrays into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions.remember import remembered
from vitaloom.functions.rows import unfold
from vitaloom.functions.text import unless_empty

LINES = "array<struct<section:string,kind:string,text:string>>"


def _line(section: str, kind: str, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), F.lit(kind).alias("kind"), text.alias("text")
    )


def _lines(section: str, kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda text: _line(section, kind, text))


def _one(section: str, kind: str, text: Column) -> Column:
    """A single line, or none for a null text."""
    return F.filter(
        F.array(_line(section, kind, text)), lambda line: line["text"].isNotNull()
    )


def _headed(section: str, title: str, lines: Column, shown: Column | None = None) -> Column:
    """A section heading above its lines; nothing at all for a section without content."""
    head = F.array(_line(section, "section_heading", F.lit(title)))
    shown = F.size(lines) > 0 if shown is None else shown
    return F.when(shown, F.concat(head, lines)).otherwise(F.array().cast(LINES))


def _joined(values: list[Column], sep: str) -> Column:
    return unless_empty(F.concat_ws(sep, *[unless_empty(v) for v in values]))


def _detail_lines(section: str, title: str, context: Column) -> Column:
    texts = F.transform(
        context["additional_details"],
        lambda d: F.concat(d["label"], F.lit(": "), d["value"]),
    )
    return _headed(section, title, _lines(section, "paragraph", texts))


def _entries(section: str, title: str, entries: Column, one_entry) -> Column:
    lines = F.flatten(F.transform(entries, one_entry))
    return _headed(section, title, lines, shown=F.size(entries) > 0)


def apex_lines(context: Column) -> Column:
    """Standard layout: fixed section order, values joined by bars."""

    def experience(x: Column) -> Column:
        return F.concat(
            _one("experience", "entry_heading", _joined(
                [x["title"], x["company"], x["date_range"]], " | "
            )),
            _one("experience", "paragraph", unless_empty(x["location"])),
            _lines("experience", "bullet", x["description"]),
        )

    def education(x: Column) -> Column:
        return _one("education", "paragraph", _joined(
            [x["institution"], x["degree"], x["field_of_study"], x["date_range"]], " | "
        ))

    return F.concat(
        _one("header", "title", F.lit("Candidate Profile")),
        _one("header", "heading", context["candidate_heading"]),
        _one("header", "paragraph", context["candidate_subheading"]),
        _headed("contact", "Contact", _lines("contact", "paragraph", context["contact_lines"])),
        _headed("summary", "Professional Summary", _one(
            "summary", "paragraph", context["professional_summary"]
        )),
        _headed("skills", "Skills", _lines("skills", "bullet", context["skills"])),
        _headed("languages", "Languages", _lines("languages", "bullet", context["languages"])),
        _entries("experience", "Work Experience", context["work_experience"], experience),
        _entries("education", "Education", context["education"], education),
        _headed("certifications", "Certifications", _lines(
            "certifications", "bullet", context["certifications"]
        )),
        _detail_lines("additional_details", "Additional Details", context),
    )


def grid_columns(skills: Column, max_columns: Column) -> Column:
    return F.least(max_columns, F.greatest(F.lit(1), F.size(skills)))


def grid_rows(skills: Column, max_columns: Column) -> Column:
    return F.ceil(F.size(skills) / grid_columns(skills, max_columns)).cast("int")


def highlights_grid(skills: Column, max_columns: Column) -> Column:
    """Array of (grid_row, grid_column, text): filled column by column, both from 0."""
    rows = F.greatest(grid_rows(skills, max_columns), F.lit(1))
    return F.transform(
        skills,
        lambda text, i: F.struct(
            (i % rows).alias("grid_row"),
            F.floor(i / rows).cast("int").alias("grid_column"),
            text.alias("text"),
        ),
    )


def classic_lines(context: Column, section_order: Column, skills_columns: Column) -> Column:
    """Classic layout: sections in the blueprint's order, values joined by blanks."""

    def dates(x: Column) -> Column:
        return F.replace(x["date_range"], F.lit(" - "), F.lit(" to "))

    def experience(x: Column) -> Column:
        return F.concat(
            _one("experience", "entry_heading", _joined(
                [x["company"], dates(x), x["title"]], " "
            )),
            _one("experience", "paragraph", unless_empty(x["location"])),
            _lines("experience", "bullet", x["description"]),
        )

    def education(x: Column) -> Column:
        return _one("education", "paragraph", _joined(
            [x["institution"], dates(x), x["degree"], x["field_of_study"]], " "
        ))

    skills = context["skills"]
    # The grid is read row by row, as the cells of a table are.
    cells = F.transform(
        F.array_sort(highlights_grid(skills, skills_columns)), lambda cell: cell["text"]
    )
    title = F.coalesce(
        unless_empty(context["candidate_subheading"]),
        unless_empty(context["candidate_heading"]),
    )
    by_section = {
        "header": _one(
            "header", "title", F.upper(F.substring_index(title, " | ", 1))
        ),
        "contact": _headed(
            "contact", "Contact", _lines("contact", "paragraph", context["contact_lines"])
        ),
        "summary": _headed("summary", "Summary", _one(
            "summary", "paragraph", context["professional_summary"]
        )),
        "highlights": _headed("highlights", "Highlights", _lines("highlights", "cell", cells)),
        "languages": _headed(
            "languages", "Languages", _lines("languages", "paragraph", context["languages"])
        ),
        "experience": _entries(
            "experience", "Experience", context["work_experience"], experience
        ),
        "education": _entries("education", "Education", context["education"], education),
        "certifications": _headed("certifications", "Certifications", _lines(
            "certifications", "paragraph", context["certifications"]
        )),
        "additional_details": _detail_lines(
            "additional_details", "Additional Information", context
        ),
        "skills": _headed("skills", "Skills", _one(
            "skills",
            "paragraph",
            F.when(
                F.size(skills) > 0, F.concat(F.array_join(skills, "; "), F.lit("."))
            ),
        )),
    }
    return _in_order(by_section, section_order)


def _in_order(by_section: dict[str, Column], section_order: Column) -> Column:
    """The lines of the sections at all their positions in the order; names it does not know
    have none. Each section's lines are computed once for each position that asks for them."""

    def placed(name: str, lines: Column) -> Column:
        named = F.transform(section_order, lambda s, i: F.when(s == name, i))
        return F.transform(
            F.array_compact(named), lambda i: F.struct(i.alias("i"), lines.alias("lines"))
        )

    parts = F.concat(*[placed(name, lines) for name, lines in by_section.items()])
    return F.flatten(F.transform(F.array_sort(parts), lambda part: part["lines"]))


def lines_for(
    context: Column, renderer_key: Column, section_order: Column, skills_columns: Column
) -> Column:
    """Lines by the blueprint's renderer; one pass whatever mix of templates a corpus has.

    Null where the renderer is not known: such a document is refused, with its reason.
    """
    return F.when(
        renderer_key == C.CLASSIC_RENDERER,
        classic_lines(context, section_order, skills_columns),
    ).when(renderer_key.isin(*C.RENDERER_KEYS), apex_lines(context))


def lay_out(df: DataFrame) -> DataFrame:
    """Adds `lines` to rows with `context` and the blueprint columns layout needs."""
    return df.withColumn("lines", _chosen_lines())


@remembered
def _chosen_lines() -> Column:
    return lines_for(
        F.col("context"), F.col("renderer_key"), F.col("section_order"), F.col("skills_columns")
    )


def positions(df: DataFrame, lines: str, *keep: str) -> DataFrame:
    """One row per line with its `line_no` in the document."""
    return unfold(df, lines, *keep).select(
        *keep, F.col("pos").alias("line_no"), "item.section", "item.kind", "item.text"
    )


def positions_or_reason(df: DataFrame, lines: str, *keep: str) -> DataFrame:
    """`positions`, and one row with its `reason` as text for each refused document.

    One pass over `df`: a union of both kinds of rows would compute what lines and reasons are
    made of once for each.
    """
    refused = F.struct(
        F.lit(None).cast("string").alias("section"),
        F.lit("refused").alias("kind"),
        F.col("reason").alias("text"),
    )
    rows = df.withColumn(
        "_rows", F.when(F.col("reason").isNull(), F.col(lines)).otherwise(F.array(refused))
    )
    return unfold(rows, "_rows", *keep, "reason").select(
        *keep,
        F.when(F.col("reason").isNull(), F.col("pos")).alias("line_no"),
        "item.section",
        "item.kind",
        "item.text",
    )
