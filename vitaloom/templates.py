"""The built-in template registry.

The values below are fixed: layouts must come out as the established templates define them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.operators.blueprints import check_blueprints, registry


def _style(font: str, size: float, bold: bool, color: str, spacing: float, before: float,
           after: float) -> dict:
    return {
        "font_name": font,
        "size_pt": size,
        "bold": bold,
        "italic": False,
        "color_hex": color,
        "line_spacing": spacing,
        "space_before_pt": before,
        "space_after_pt": after,
    }


_OVERFLOW = {
    "allow_automatic_page_breaks": True,
    "keep_experience_heading_with_first_bullet": True,
    "keep_section_heading_with_next": True,
    "widow_control": True,
    "split_long_experience_entries": True,
}

# --- fixed values: the two registered templates -----------------------------------------
BUILT_IN = (
    {
        "template_id": "apex_standard",
        "version": 1,
        "display_name": "Apex Standard",
        "source_reference_type": "built_in",
        "source_sha256": [],
        "renderer_key": "apex_standard",
        "page": {
            "width_inches": 8.27,
            "height_inches": 11.69,
            "top_margin_inches": 0.75,
            "right_margin_inches": 0.75,
            "bottom_margin_inches": 0.75,
            "left_margin_inches": 0.75,
            "header_distance_inches": 0.3,
            "footer_distance_inches": 0.3,
        },
        "typography": {
            "normal": _style("Arial", 10.0, False, "000000", 1.08, 0.0, 4.0),
            "title": _style("Arial", 20.0, True, "203452", 1.0, 0.0, 6.0),
            "section": _style("Arial", 12.0, True, "203452", 1.0, 8.0, 4.0),
            "entry_heading": _style("Arial", 10.0, True, "000000", 1.0, 3.0, 2.0),
        },
        "section_order": [
            "header",
            "contact",
            "summary",
            "highlights",
            "languages",
            "experience",
            "education",
            "certifications",
            "additional_details",
        ],
        "field_mappings": {
            "header": "candidate_heading",
            "summary": "professional_summary",
            "highlights": "skills",
            "experience": "work_experience",
            "education": "education",
            "certifications": "certifications",
        },
        "skills_columns": 1,
        "bullet_left_indent_inches": 0.25,
        "bullet_hanging_indent_inches": 0.14,
        "overflow": _OVERFLOW,
    },
    {
        "template_id": "client_10554236_v1",
        "version": 1,
        "display_name": "Classic Accounting Resume",
        "source_reference_type": "pdf_reference",
        "source_sha256": ["8f80e114c8340ef1ff3b7a76003615cc0366ea5d4ad007ae5c061e7f5fd759e8"],
        "renderer_key": "classic_10554236",
        "page": {
            "width_inches": 8.2639,
            "height_inches": 11.6944,
            "top_margin_inches": 0.42,
            "right_margin_inches": 0.46,
            "bottom_margin_inches": 0.5,
            "left_margin_inches": 0.46,
            "header_distance_inches": 0.2,
            "footer_distance_inches": 0.2,
        },
        "typography": {
            "normal": _style("Times New Roman", 10.0, False, "000000", 1.0, 0.0, 1.5),
            "title": _style("Times New Roman", 10.5, False, "000000", 1.0, 0.0, 1.0),
            "section": _style("Times New Roman", 10.0, False, "000000", 1.0, 9.0, 4.0),
            "entry_heading": _style("Times New Roman", 10.0, False, "000000", 1.0, 7.0, 0.0),
        },
        "section_order": [
            "header",
            "summary",
            "highlights",
            "languages",
            "experience",
            "education",
            "certifications",
            "additional_details",
            "skills",
        ],
        "field_mappings": {
            "header": "candidate_subheading_or_heading",
            "summary": "professional_summary",
            "highlights": "skills",
            "languages": "languages",
            "experience": "work_experience",
            "education": "education",
            "certifications": "certifications",
            "additional_details": "additional_details",
            "skills": "skills",
        },
        "skills_columns": 2,
        "bullet_left_indent_inches": 0.22,
        "bullet_hanging_indent_inches": 0.12,
        "overflow": _OVERFLOW,
    },
)


def built_in_payloads(spark: SparkSession) -> DataFrame:
    """(path, payload) as if read from `<template_id>/blueprint.json` files.

    Literals, so that Spark knows how small this is and broadcasts it by its own rule.
    """
    rows = [
        F.struct(
            F.lit(f"{b['template_id']}/blueprint.json").alias("path"),
            F.lit(json.dumps(b)).alias("payload"),
        )
        for b in BUILT_IN
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def built_in_registry(spark: SparkSession) -> DataFrame:
    return registry(check_blueprints(built_in_payloads(spark)))
