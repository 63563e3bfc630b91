"""Text -> profile with native expressions only: no UDF, no join, no shuffle.

The work is laid out in stages, so that lines, section blocks and label hits are computed
once per document and reused by every field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions import entries, rules, sections
from vitaloom.functions import text as tx
from vitaloom.functions.remember import remembered
from vitaloom.functions.rows import unfold
from vitaloom.operators.review import with_missing


SECTIONS = tuple(dict.fromkeys(C.SECTION_HEADINGS.values()))


def label_column(name: str) -> str:
    return "label_" + name.lower().replace(" ", "_")


def section_column(name: str) -> str:
    return "section_" + name


def segment(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Adds what the fields of a document are read from.

    `blocks` per heading, `section_*` the lines of each section and `label_*` the value of
    each label. Columns that a later select does not use are pruned by Catalyst, and those
    used several times stay in their own projection, so each is computed once.
    """
    kept = [F.col(k) for k in keep]
    source = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select(
            *kept, source.alias("text"), tx.with_plain_line_ends(source).alias("lined")
        )
        .select(
            *kept,
            "text",
            "lined",
            sections.heading_cuts(F.col("lined")).alias("cuts"),
            tx.label_hits(F.col("text")).alias("label_hits"),
        )
        .select(
            *kept,
            "text",
            "lined",
            *block_and_label_columns(),
        )
        .select("*", *section_columns())
    )


@remembered
def block_and_label_columns() -> list[Column]:
    blocks = sections.section_blocks(F.col("cuts"))
    labels = [
        tx.label_value(F.col("label_hits"), name).alias(label_column(name)) for name in C.LABELS
    ]
    return [blocks.alias("blocks"), *labels]


@remembered
def section_columns() -> list[Column]:
    return [
        sections.section_lines(F.col("blocks"), name).alias(section_column(name))
        for name in SECTIONS
    ]


def section(name: str) -> Column:
    return F.col(section_column(name))


def label(name: str) -> Column:
    return F.col(label_column(name))


def location() -> Column:
    """The Location label unless blank, else the Address label."""
    return F.when(label("Location") != "", label("Location")).otherwise(label("Address"))


def listed(label_name: str, section_name: str) -> Column:
    """Items of a `Label: a, b` line when it has any, else of the section."""
    has_items = F.coalesce(F.rlike(label(label_name), F.lit(rf"[^,{C.SPACE}]")), F.lit(False))
    return F.when(has_items, tx.comma_items(label(label_name))).otherwise(
        tx.marked_items(section(section_name))
    )


def summary() -> Column:
    """The summary section; failing that, the line under a bare `Summary` heading."""
    bare = F.exists(F.col("blocks"), lambda b: b["heading"] == "summary")
    return F.coalesce(
        sections.section_text(section("professional_summary")),
        F.when(bare, sections.line_after(F.col("lined"), "summary")),
    )


@remembered
def profile_columns() -> dict[str, Column]:
    """One expression per profile field, over the columns that `segment` adds."""
    text = F.col("text")
    return {
        "full_name": tx.first_line(F.col("lined")),
        "email": tx.email(text),
        "phone": tx.phone(text),
        "location": location(),
        "linkedin_url": tx.linkedin_url(text),
        "portfolio_url": tx.portfolio_url(text),
        "professional_summary": summary(),
        "skills": listed("Skills", "skills"),
        "languages": entries.language_entries(listed("Languages", "languages")),
        "work_experience": entries.experience_entries(
            section("experience"), section("projects"), section("achievements")
        ),
        "education": entries.education_entries(section("education")),
        "certifications": entries.certification_entries(section("certifications")),
        "salary_expectation": label("Salary expectation"),
        "notice_period": label("Notice period"),
        "work_authorization": label("Work authorization"),
        "interview_availability": label("Interview availability"),
        "missing_fields": F.array().cast(S.PROFILE["missing_fields"].dataType),
        "client_display_rules": rules.no_rules(),
    }


def extract_fields(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Flat form: the kept columns and one column per profile field, not yet reviewed."""
    return segment(docs, *keep, text=text).select(
        *[F.col(k) for k in keep],
        *[expr.alias(name) for name, expr in profile_columns().items()],
    )


def extract_profiles(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and `profile`, with missing fields and default rules applied."""
    flat = extract_fields(docs, *keep, text=text)
    profile = F.struct(*[F.col(f.name) for f in S.PROFILE.fields])
    return with_missing(flat.select(*[F.col(k) for k in keep], profile.alias("profile")))


def document_lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Long form: one row per solid line, with the section its heading opens, if any."""
    lines = tx.solid_lines(tx.with_plain_line_ends(F.coalesce(F.col(text), F.lit(""))))
    rows = unfold(docs.select(*[F.col(k) for k in keep], lines.alias("lines")), "lines", *keep)
    return rows.select(
        *keep,
        F.col("pos").alias("line_no"),
        F.col("item").alias("line"),
        sections.heading_section(F.col("item")).alias("heading"),
    )


def document_sections(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Long form: one row per line that stands in a section."""
    blocks = unfold(segment(docs, *keep, text=text), "blocks", *keep).select(
        *keep,
        F.col("pos").alias("block_no"),
        F.col("item.section").alias("section"),
        F.col("item.lines").alias("lines"),
    )
    return unfold(blocks, "lines", *keep, "block_no", "section").withColumnRenamed(
        "item", "line"
    )


def prompts(
    docs: DataFrame,
    *keep: str,
    text: str = "text",
    job_description: str | None = None,
    schema_text: str | None = None,
) -> DataFrame:
    """The kept columns and the extraction `prompt` for a completion client."""
    import json

    schema_text = schema_text or json.dumps(S.json_schema(S.PROFILE))
    head = f"{C.PROMPT_TASK}\nSchema:\n{schema_text}\n"
    if job_description:
        job = F.col(job_description)
        head_col = F.concat(
            F.lit(head),
            F.when(
                F.coalesce(job, F.lit("")) != "",
                F.concat(F.lit("\nOptional job description:\n"), job, F.lit("\n")),
            ).otherwise(F.lit("")),
        )
    else:
        head_col = F.lit(head)
    return docs.select(
        *[F.col(k) for k in keep],
        F.concat(head_col, F.lit(f"\n{C.PROMPT_TEXT_MARK}\n"), F.col(text)).alias("prompt"),
    )


def prompt_text(prompt: Column) -> Column:
    """Everything after the first text mark of a prompt; the whole prompt without one."""
    return F.get(
        F.slice(F.split(prompt, C.PROMPT_TEXT_MARK, 2), -1, 1),
        0,
    )
