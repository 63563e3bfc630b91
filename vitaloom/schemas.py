"""Fixed Spark schemas; nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


STRING_LIST = T.ArrayType(T.StringType())

LANGUAGE = T.StructType(_strings("name", "proficiency"))
WORK_EXPERIENCE = T.StructType(
    _strings("company", "title", "location", "start_date", "end_date")
    + [T.StructField("description", STRING_LIST)]
)
EDUCATION = T.StructType(
    _strings("institution", "degree", "field_of_study", "start_date", "end_date")
)
CERTIFICATION = T.StructType(_strings("name", "issuer", "date"))
MISSING_FIELD = T.StructType(_strings("field_name", "label", "reason"))

PROFILE = T.StructType(
    _strings(
        "full_name",
        "email",
        "phone",
        "location",
        "linkedin_url",
        "portfolio_url",
        "professional_summary",
    )
    + [
        T.StructField("skills", STRING_LIST),
        T.StructField("languages", T.ArrayType(LANGUAGE)),
        T.StructField("work_experience", T.ArrayType(WORK_EXPERIENCE)),
        T.StructField("education", T.ArrayType(EDUCATION)),
        T.StructField("certifications", T.ArrayType(CERTIFICATION)),
    ]
    + _strings(
        "salary_expectation",
        "notice_period",
        "work_authorization",
        "interview_availability",
    )
    + [
        T.StructField("missing_fields", T.ArrayType(MISSING_FIELD)),
        T.StructField("client_display_rules", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Parts of the profile that describe the review, not the candidate.
REVIEW_FIELDS = ("missing_fields", "client_display_rules")

TEXT_STYLE = T.StructType(
    [
        T.StructField("font_name", T.StringType()),
        T.StructField("size_pt", T.DoubleType()),
        T.StructField("bold", T.BooleanType()),
        T.StructField("italic", T.BooleanType()),
        T.StructField("color_hex", T.StringType()),
        T.StructField("line_spacing", T.DoubleType()),
        T.StructField("space_before_pt", T.DoubleType()),
        T.StructField("space_after_pt", T.DoubleType()),
    ]
)
PAGE_SIZES = ("width_inches", "height_inches")
PAGE_MARGINS = (
    "top_margin_inches",
    "right_margin_inches",
    "bottom_margin_inches",
    "left_margin_inches",
    "header_distance_inches",
    "footer_distance_inches",
)
OVERFLOW_FLAGS = (
    "allow_automatic_page_breaks",
    "keep_experience_heading_with_first_bullet",
    "keep_section_heading_with_next",
    "widow_control",
    "split_long_experience_entries",
)
BLUEPRINT = T.StructType(
    [
        T.StructField("template_id", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("source_reference_type", T.StringType()),
        T.StructField("source_sha256", STRING_LIST),
        T.StructField("renderer_key", T.StringType()),
        T.StructField(
            "page",
            T.StructType([T.StructField(n, T.DoubleType()) for n in PAGE_SIZES + PAGE_MARGINS]),
        ),
        T.StructField("typography", T.MapType(T.StringType(), TEXT_STYLE)),
        T.StructField("section_order", STRING_LIST),
        T.StructField("field_mappings", T.MapType(T.StringType(), T.StringType())),
        T.StructField("skills_columns", T.IntegerType()),
        T.StructField("bullet_left_indent_inches", T.DoubleType()),
        T.StructField("bullet_hanging_indent_inches", T.DoubleType()),
        T.StructField(
            "overflow",
            T.StructType([T.StructField(n, T.BooleanType()) for n in OVERFLOW_FLAGS]),
        ),
    ]
)

TARGET_FORMAT = T.StructType(
    _strings(
        "artifact_id",
        "input_filename",
        "stored_filename",
        "input_type",
        "role",
        "generation_strategy",
    )
    + [
        T.StructField("accepted_for_generation", T.BooleanType()),
        T.StructField("used_as_template_source", T.BooleanType()),
    ]
    + _strings("download_url", "note", "matched_template_id")
    + [
        T.StructField("blueprint_version", T.IntegerType()),
        T.StructField("format_support", T.StringType()),
    ]
)

# One row per state change of an artifact. A writer fills only its own columns.
ARTIFACT_EVENT = T.StructType(
    _strings("artifact_id")
    + [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
    ]
    + _strings(
        "event_type",
        "artifact_dir",
        "source_filename",
        "source_file_type",
        "original_pdf_preview_url",
        "original_preview_error",
        "target_format_role",
        "target_format_filename",
        "target_format_download_url",
        "template_name",
    )
    + [T.StructField("blind_profile", T.BooleanType())]
    + _strings("docx_download_url", "pdf_download_url", "pdf_preview_url")
    + [
        T.StructField("missing_field_labels", STRING_LIST),
        T.StructField("debug_artifacts", T.MapType(T.StringType(), T.StringType())),
    ]
)

EDIT = T.StructType(
    _strings("artifact_id", "path", "value") + [T.StructField("seq", T.LongType())]
)

COMPLETION = T.StructType(_strings("doc_id", "raw_response", "error"))
# Answers as they are kept: for which prompt and model, and in which run.
KEPT_COMPLETION = T.StructType(
    [
        *_strings("doc_id", "prompt_key", "raw_response", "error"),
        T.StructField("attempt", T.LongType()),
    ]
)


def json_schema(dtype: T.DataType) -> dict:
    """JSON-Schema view of a Spark type, for the extraction prompt."""
    if isinstance(dtype, T.StructType):
        return {
            "type": "object",
            "additionalProperties": False,
            "properties": {f.name: json_schema(f.dataType) for f in dtype.fields},
        }
    if isinstance(dtype, T.ArrayType):
        return {"type": "array", "items": json_schema(dtype.elementType)}
    if isinstance(dtype, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(dtype.valueType)}
    return {"type": ["string", "null"]}
