"""Template registry: checks, fingerprint match and the template that takes effect.

No join here is forced to broadcast. A registry read from files has a known size, so
Spark broadcasts it below `spark.sql.autoBroadcastJoinThreshold` and otherwise sorts and
merges, splitting hot keys of the large side (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions import conform, nested
from vitaloom.functions.remember import remembered
from vitaloom.functions.rows import keep_where
from vitaloom.operators.validate import suffix


def check_blueprints(payloads: DataFrame, raw: str = "payload") -> DataFrame:
    """Adds `value` (VARIANT) and the `violations` of a blueprint's JSON text."""
    value = conform.parse_json(F.col(raw))
    return payloads.withColumn("value", value).withColumn("violations", _blueprint_violations())


@remembered
def _blueprint_violations() -> Column:
    return F.when(F.col("value").isNull(), F.array(F.lit("payload: not JSON"))).otherwise(
        conform.violations(F.col("value"), conform.BLUEPRINT_SHAPE)
    )


@remembered
def _tidy() -> Column:
    return nested.tidy(F.col("typed"), S.BLUEPRINT)


@remembered
def _settled() -> Column:
    """Default styles, and colours in their stored form."""
    blueprint = F.col("tidy")

    def style(value: Column) -> Column:
        colour = F.upper(F.regexp_replace(value["color_hex"], "^#", ""))
        return F.struct(
            value["font_name"].alias("font_name"),
            value["size_pt"].alias("size_pt"),
            F.coalesce(value["bold"], F.lit(False)).alias("bold"),
            F.coalesce(value["italic"], F.lit(False)).alias("italic"),
            F.coalesce(colour, F.lit("000000")).alias("color_hex"),
            value["line_spacing"].alias("line_spacing"),
            value["space_before_pt"].alias("space_before_pt"),
            value["space_after_pt"].alias("space_after_pt"),
        )

    return blueprint.withField(
        "typography", F.transform_values(blueprint["typography"], lambda _, v: style(v))
    )


def registry(checked: DataFrame, path: str = "path") -> DataFrame:
    """Accepted blueprints as rows, in the registry's order column `path`.

    An id registered twice is an error of the registry; see `duplicate_ids`.
    """
    typed = F.try_variant_get(F.col("value"), "$", S.BLUEPRINT.simpleString())
    return (
        keep_where(
            checked.select(path, "value", (F.size("violations") == 0).alias("accepted")),
            "accepted",
        )
        .select(path, typed.alias("typed"))
        .select(path, _tidy().alias("tidy"))
        .select(path, _settled().alias("blueprint"))
        .select(path, "blueprint.*")
    )


def duplicate_ids(registered: DataFrame) -> DataFrame:
    return (
        registered.groupBy("template_id")
        .agg(F.count(F.lit(1)).alias("registrations"))
        .where(F.col("registrations") > 1)
    )


def fingerprints(registered: DataFrame) -> DataFrame:
    """One row per (fingerprint, source type): the first blueprint in path order.

    Settled before the join, so that no upload can match more than one row.
    """
    return (
        registered.select(
            F.explode("source_sha256").alias("sha256"),
            "source_reference_type",
            "path",
            F.struct("template_id", "version").alias("_match"),
        )
        .groupBy("sha256", "source_reference_type")
        .agg(F.min_by("_match", "path").alias("_match"))
        .select(
            "sha256",
            "source_reference_type",
            F.col("_match.template_id").alias("matched_template_id"),
            F.col("_match.version").alias("blueprint_version"),
        )
    )


def source_type(input_filename: Column) -> Column:
    return F.when(suffix(input_filename) == ".docx", F.lit("docx")).otherwise(
        F.lit("pdf_reference")
    )


def match_blueprints(
    uploads: DataFrame, registered: DataFrame, content: str = "content"
) -> DataFrame:
    """Replaces `content` of the uploads by the match of its fingerprint and source type."""
    hashed = uploads.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).withColumn(
        "source_reference_type", source_type(F.col("input_filename"))
    ).drop(content)
    return hashed.join(fingerprints(registered), ["sha256", "source_reference_type"], "left")


def artifact_url(artifact_id: Column, filename: Column, download: bool = False) -> Column:
    tail = "?download=1" if download else ""
    return F.concat(F.lit("/api/artifacts/"), artifact_id, F.lit("/"), filename, F.lit(tail))


def metadata_url(artifact_id: Column) -> Column:
    return F.concat(F.lit("/api/artifacts/"), artifact_id, F.lit("/metadata"))


def target_format(matched: DataFrame) -> DataFrame:
    """Metadata record of each matched upload, as `target_format`; keeps `artifact_id`."""
    is_docx = F.col("source_reference_type") == "docx"
    has_match = F.col("matched_template_id").isNotNull()
    role = F.when(is_docx, F.lit("docx_template")).otherwise(F.lit("pdf_reference"))
    stored = F.when(is_docx, F.lit(C.STORED_FILE_BY_ROLE["docx_template"])).otherwise(
        F.lit(C.STORED_FILE_BY_ROLE["pdf_reference"])
    )
    note = (
        F.when(
            has_match,
            F.concat(
                F.lit(C.NOTE_MATCH_HEAD),
                F.col("matched_template_id"),
                F.lit(" version "),
                F.col("blueprint_version").cast("string"),
                F.lit(C.NOTE_MATCH_TAIL),
            ),
        )
        .when(is_docx, F.lit(C.NOTE_DOCX))
        .otherwise(F.lit(C.NOTE_PDF))
    )
    record = {
        "artifact_id": F.col("artifact_id"),
        "input_filename": F.col("input_filename"),
        "stored_filename": stored,
        "input_type": F.ltrim(suffix(F.col("input_filename")), F.lit(".")),
        "role": role,
        "generation_strategy": F.when(
            has_match, F.lit("registered_target_format_blueprint")
        ).otherwise(F.lit("controlled_docx_renderer")),
        "accepted_for_generation": F.lit(True),
        "used_as_template_source": is_docx & has_match,
        "download_url": artifact_url(F.col("artifact_id"), stored),
        "note": note,
        "matched_template_id": F.col("matched_template_id"),
        "blueprint_version": F.col("blueprint_version").cast("int"),
        "format_support": F.when(has_match, F.lit("manual_blueprint")).otherwise(
            F.lit("reference_only")
        ),
    }
    return matched.select(
        "artifact_id",
        F.struct(*[v.alias(k) for k, v in record.items()]).alias("target_format"),
    )


def choose_artifact_id(requested: Column, from_target: Column) -> Column:
    """The id of the request, else of its target format, else a new one."""
    return F.coalesce(
        F.nullif(requested, F.lit("")),
        F.nullif(from_target, F.lit("")),
        F.concat(F.lit("artifact_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))),
    )


def effective_template(
    requests: DataFrame, registered: DataFrame, matched: str = "matched_template_id"
) -> DataFrame:
    """Adds `template_id`, the blueprint columns layout needs, and `reason` when unknown."""
    known = registered.select(
        "template_id",
        "renderer_key",
        "section_order",
        "skills_columns",
        F.lit(True).alias("_known"),
    )
    template = F.coalesce(
        F.nullif(F.col(matched), F.lit("")),
        F.col("template_name"),
        F.lit(C.DEFAULT_TEMPLATE),
    )
    return (
        requests.withColumn("template_id", template)
        .join(known, "template_id", "left")
        .withColumn(
            "reason",
            F.when(
                F.col("_known").isNull(),
                F.concat(F.lit("Unknown target format blueprint: "), F.col("template_id")),
            ),
        )
        .drop("_known")
    )


def check_references(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds `reason` where the target format sent with a request does not hold.

    `requests`: artifact_id, target_format (struct). `stored`: artifact_id (unique),
    stored_files (list of names) and metadata_json, the record written at upload.
    """
    sent = F.col("target_format")
    on_disk = F.from_json(F.col("metadata_json"), S.TARGET_FORMAT)
    names = [f.name for f in S.TARGET_FORMAT.fields]
    optional = ("matched_template_id", "blueprint_version", "format_support")
    whole = F.lit(True)
    same = F.lit(True)
    for name in names:
        value = F.col("_disk")[name]
        if name == "format_support":
            value = F.coalesce(value, F.lit("reference_only"))
        if name not in optional:
            whole = whole & value.isNotNull()
        same = same & value.eqNullSafe(sent[name])
    expected = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in C.STORED_FILE_BY_ROLE.items() for x in kv]),
        sent["role"],
    )
    well_formed = (
        (sent["stored_filename"] == expected)
        & (sent["download_url"] == artifact_url(F.col("artifact_id"), expected))
    )
    uploaded = F.array_contains(
        F.coalesce(F.col("stored_files"), F.array().cast("array<string>")),
        sent["stored_filename"],
    )
    reason = (
        F.when(sent.isNull(), F.lit(None).cast("string"))
        .when(~sent["artifact_id"].eqNullSafe(F.col("artifact_id")), F.lit(C.REF_ID_MISMATCH))
        .when(~F.coalesce(well_formed, F.lit(False)), F.lit(C.REF_INVALID))
        .when(~uploaded, F.lit(C.REF_NOT_UPLOADED))
        .when(F.col("metadata_json").isNull(), F.lit(C.REF_METADATA_MISSING))
        .when(~F.coalesce(whole, F.lit(False)), F.lit(C.REF_METADATA_INVALID))
        .when(~same, F.lit(C.REF_METADATA_DIFFERS))
    )
    return (
        requests.join(stored, "artifact_id", "left")
        .withColumn("_disk", on_disk)
        .withColumn("reason", reason)
        .drop("_disk", "stored_files", "metadata_json")
    )
