"""Registered queries: every operator over whole tables.

Lists and maps are flattened to text in the results, so that any engine can compare them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions import rules, sections
from vitaloom.functions import text as tx
from vitaloom.operators import artifacts, blueprints, corpus, edits, extract, generate, layout
from vitaloom.operators import render, review, validate
from vitaloom.functions.remember import remembered
from vitaloom.functions.rows import unfold
from vitaloom.plans import inputs as I
from vitaloom.session import shared_folder
from vitaloom.sources.bucketed import write_bucketed
from vitaloom.sources.jobs import JobTable
from vitaloom.templates import built_in_registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NONE = "-"
ITEM_SEP = " ~ "


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- flattening --------------------------------------------------------------------------
def fields_text(*values: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit(NONE)) for v in values])


def list_text(items: Column) -> Column:
    return F.array_join(items, ITEM_SEP)


def records_text(items: Column, *names: str) -> Column:
    return list_text(F.transform(items, lambda x: fields_text(*[x[n] for n in names])))


def map_text(value: Column) -> Column:
    pairs = F.transform(
        F.map_entries(value), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(F.array_sort(pairs), ITEM_SEP)


def experience_text(items: Column, *names: str) -> Column:
    return list_text(
        F.transform(
            items,
            lambda x: fields_text(*[x[n] for n in names], F.array_join(x["description"], " / ")),
        )
    )


POSITION = ("company", "title", "location", "start_date", "end_date")
SCHOOL = ("institution", "degree", "field_of_study", "start_date", "end_date")
FLAT_LISTS: dict[str, Callable[[Column], Column]] = {
    "skills": list_text,
    "languages": lambda c: records_text(c, "name", "proficiency"),
    "work_experience": lambda c: experience_text(c, *POSITION),
    "education": lambda c: records_text(c, *SCHOOL),
    "certifications": lambda c: records_text(c, "name", "issuer", "date"),
    "missing_fields": lambda c: records_text(c, "field_name", "label", "reason"),
    "client_display_rules": map_text,
}


@remembered
def flat_profile() -> list[Column]:
    profile = F.col("profile")
    return [
        FLAT_LISTS.get(f.name, lambda c: c)(profile[f.name]).alias(f.name)
        for f in S.PROFILE.fields
    ]


@remembered
def flat_context() -> list[Column]:
    context = F.col("context")
    return [
        context["template_name"].alias("template_name"),
        context["candidate_heading"].alias("candidate_heading"),
        context["candidate_subheading"].alias("candidate_subheading"),
        list_text(context["contact_lines"]).alias("contact_lines"),
        context["professional_summary"].alias("professional_summary"),
        list_text(context["skills"]).alias("skills"),
        list_text(context["languages"]).alias("languages"),
        experience_text(
            context["work_experience"], "company", "title", "location", "date_range"
        ).alias("work_experience"),
        records_text(
            context["education"], "institution", "degree", "field_of_study", "date_range"
        ).alias("education"),
        list_text(context["certifications"]).alias("certifications"),
        records_text(context["additional_details"], "label", "value").alias("additional_details"),
        context["blind_profile"].alias("blind_profile"),
    ]


# --- shared inputs -----------------------------------------------------------------------
def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_profiles(I.resumes(spark, sf_dir), "doc_id")


def resume_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.segment(I.resumes(spark, sf_dir), "doc_id")


def reviewed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with a reviewer's rules merged in, and `blind`."""
    sent = I.reviewed(resume_profiles(spark, sf_dir))
    return review.with_requested_rules(sent)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.with_context(reviewed_profiles(spark, sf_dir), F.col("blind"))


def artifact_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer profiles keyed by artifact, as the review screen loads them."""
    docs = I.customer_resumes(spark, sf_dir)
    sent = I.reviewed(extract.extract_profiles(docs, "doc_id"))
    return review.with_requested_rules(sent).select(
        F.col("doc_id").alias("artifact_id"), "profile"
    )


def in_buckets(spark: SparkSession, name: str, df: DataFrame, buckets: int) -> DataFrame:
    """`df` computed once and stored in buckets by artifact; what reads it twice reads files."""
    of_run = f"{name}_{uuid.uuid4().hex}"
    return write_bucketed(df, of_run, f"{shared_folder(spark)}/{of_run}", "artifact_id", buckets)


def kept_once(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """`df` computed once and stored; what reads it several times reads files."""
    path = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def page_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = blueprints.check_blueprints(I.blueprint_payloads(spark, sf_dir))
    return blueprints.registry(checked)


def matched_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprints.match_blueprints(I.uploads(spark, sf_dir), page_registry(spark, sf_dir))


# --- sources, validation -----------------------------------------------------------------
@query
def scan_documents(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


@query
def profile_json(spark, sf_dir):
    """Profiles written as JSON text and read back."""
    written = resume_profiles(spark, sf_dir).select(
        "doc_id", F.to_json("profile", {"ignoreNullFields": "false"}).alias("json")
    )
    back = written.select(
        "doc_id",
        F.size(F.json_object_keys("json")).cast("long").alias("keys_written"),
        F.from_json("json", S.PROFILE).alias("profile"),
    )
    return back.select("doc_id", "keys_written", *flat_profile())


@query
def quarantine_empty(spark, sf_dir):
    """Documents, and for every ninth one more of white space."""
    docs = I.with_blank_documents(spark, sf_dir)
    checked = validate.reject_empty_text(docs)
    return validate.rejected(checked).select("doc_id", "reason")


@query
def parse_llm_json(spark, sf_dir):
    parsed = validate.parse_payloads(I.payloads(spark, sf_dir))
    return parsed.select(
        "doc_id",
        F.try_variant_get("payload", "$.full_name", "string").alias("full_name"),
        F.try_variant_get("payload", "$.location", "string").alias("location"),
        "reason",
    )


@query
def strict_validate(spark, sf_dir):
    parsed = validate.parse_payloads(I.payloads(spark, sf_dir))
    result = validate.conform_profiles(parsed)
    p = F.col("profile")
    return result.select(
        "doc_id",
        "reason",
        p["full_name"].alias("full_name"),
        p["email"].alias("email"),
        p["portfolio_url"].alias("portfolio_url"),
        list_text(p["skills"]).alias("skills"),
        records_text(p["languages"], "name", "proficiency").alias("languages"),
        experience_text(p["work_experience"], *POSITION).alias("work_experience"),
        map_text(p["client_display_rules"]).alias("client_display_rules"),
    )


@query
def safe_artifact_id(spark, sf_dir):
    """Ids of many shapes derived from page addresses."""
    ids = I.table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr(
            "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('artifact_', page_id)"
            " WHEN 2 THEN concat('Größe-', page_id) WHEN 3 THEN ''"
            " WHEN 4 THEN concat('a', page_id, chr(10)) ELSE concat('a b', page_id) END"
        ).alias("artifact_id"),
    )
    return ids.select(
        "page_id", validate.is_safe_artifact_id(F.col("artifact_id")).alias("is_safe")
    )


def _file_names(spark, sf_dir):
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(
            "CASE o_orderkey % 8 WHEN 0 THEN 'candidate_profile.docx'"
            " WHEN 1 THEN 'candidate_profile.pdf' WHEN 2 THEN concat('cv ', o_custkey, '.PDF')"
            " WHEN 3 THEN 'candidate_profile.json' WHEN 4 THEN 'target_format_reference.pdf'"
            " WHEN 5 THEN concat('cv.', o_custkey, '.DocX') WHEN 6 THEN '.docx'"
            " ELSE concat('notes', o_custkey) END"
        ).alias("filename"),
    )


@query
def downloadable_filter(spark, sf_dir):
    return _file_names(spark, sf_dir).where(validate.is_downloadable(F.col("filename")))


@query
def accepted_upload(spark, sf_dir):
    return _file_names(spark, sf_dir).select(
        "o_orderkey",
        validate.suffix(F.col("filename")).alias("suffix"),
        validate.is_accepted_upload(F.col("filename")).alias("is_accepted"),
    )


# --- segmentation and fields ---------------------------------------------------------------
@query
def doc_lines(spark, sf_dir):
    docs = I.spread(I.table(spark, sf_dir, "documents"), "doc_id")
    return extract.document_lines(docs, "doc_id").select(
        "doc_id", "line_no", "line"
    )


@query
def heading_lines(spark, sf_dir):
    lines = extract.document_lines(I.resumes(spark, sf_dir), "doc_id")
    return lines.where(F.col("heading").isNotNull()).select(
        "doc_id", "line_no", "line", "heading"
    )


@query
def doc_sections(spark, sf_dir):
    return extract.document_sections(I.resumes(spark, sf_dir), "doc_id").select(
        "doc_id", "block_no", "section", "pos", "line"
    )


def _document_field(spark, sf_dir, name):
    docs = I.spread(I.table(spark, sf_dir, "documents"), "doc_id")
    return extract.extract_fields(docs, "doc_id").select("doc_id", name)


@query
def first_line(spark, sf_dir):
    return _document_field(spark, sf_dir, "full_name")


@query
def contact_email(spark, sf_dir):
    return _document_field(spark, sf_dir, "email")


@query
def contact_phone(spark, sf_dir):
    return _document_field(spark, sf_dir, "phone")


@query
def contact_urls(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    return fields.select("doc_id", "email", "phone", "linkedin_url", "portfolio_url")


@query
def label_values(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    return fields.select(
        "doc_id",
        "location",
        "salary_expectation",
        "notice_period",
        "work_authorization",
        "interview_availability",
    )


@query
def summary_fallback(spark, sf_dir):
    segments = resume_segments(spark, sf_dir)
    return segments.select(
        "doc_id", sections.line_after(F.col("lined"), "summary").alias("line_below")
    )


@query
def summary_text(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    return fields.select("doc_id", "professional_summary")


@query
def skills_list(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    return unfold(fields, "skills", "doc_id").withColumnRenamed("item", "skill")


@query
def clean_items(spark, sf_dir):
    lines = extract.document_lines(I.resumes(spark, sf_dir), "doc_id")
    return lines.select(
        "doc_id",
        "line_no",
        tx.clean_item(F.col("line")).alias("item"),
    )


@query
def experience_entries(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    rows = unfold(fields, "work_experience", "doc_id")
    return rows.select(
        "doc_id",
        *[F.col(f"item.{n}") for n in POSITION],
        list_text(F.col("item.description")).alias("description"),
    )


@query
def date_ranges(spark, sf_dir):
    """Date ranges of all text in brackets."""
    lines = extract.document_lines(I.resumes(spark, sf_dir), "doc_id")
    bracketed = lines.select(
        "doc_id",
        "line_no",
        F.explode(F.regexp_extract_all("line", F.lit(r"\(([^)]+)\)"), F.lit(1))).alias("inner"),
    )
    spans = bracketed.withColumn("dates", tx.date_range(F.col("inner")))
    return spans.select("doc_id", "line_no", "dates.start_date", "dates.end_date")


@query
def education_entries(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    rows = unfold(fields, "education", "doc_id")
    return rows.select(
        "doc_id", "pos", *[F.col(f"item.{n}") for n in SCHOOL]
    )


@query
def certification_entries(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    rows = unfold(fields, "certifications", "doc_id")
    return rows.select(
        "doc_id", "pos", "item.name", "item.issuer", "item.date"
    )


@query
def language_entries(spark, sf_dir):
    fields = extract.extract_fields(I.resumes(spark, sf_dir), "doc_id")
    rows = unfold(fields, "languages", "doc_id")
    return rows.select(
        "doc_id", "pos", "item.name", "item.proficiency"
    )


@query
def profiles(spark, sf_dir):
    return resume_profiles(spark, sf_dir).select("doc_id", *flat_profile())


@query
def prompts(spark, sf_dir):
    """Extraction prompts; the source of a document stands in for a job description."""
    docs = I.table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.expr("CASE WHEN lang = 'en' THEN concat('Writer for ', source) END").alias("job"),
    )
    prompted = extract.prompts(docs, "doc_id", job_description="job")
    return prompted.select(
        "doc_id", "prompt", extract.prompt_text(F.col("prompt")).alias("text_part")
    )


# --- profile operators ---------------------------------------------------------------------
@query
def missing_fields(spark, sf_dir):
    rows = unfold(resume_profiles(spark, sf_dir), "profile.missing_fields", "doc_id")
    return rows.select(
        "doc_id",
        "pos",
        "item.field_name",
        "item.label",
        "item.reason",
    )


@query
def default_rules(spark, sf_dir):
    return resume_profiles(spark, sf_dir).select(
        "doc_id", map_text(F.col("profile.client_display_rules")).alias("rules")
    )


@query
def merged_rules(spark, sf_dir):
    return reviewed_profiles(spark, sf_dir).select(
        "doc_id", map_text(F.col("profile.client_display_rules")).alias("rules")
    )


@query
def dedup_skills(spark, sf_dir):
    normal = review.normalized(resume_profiles(spark, sf_dir))
    return normal.select("doc_id", list_text(F.col("profile.skills")).alias("skills"))


@query
def ledger(spark, sf_dir):
    counted = resume_profiles(spark, sf_dir).select(
        "doc_id", rules.ledger(F.col("profile")).alias("l")
    )
    return counted.select(
        "doc_id",
        *[F.col(f"l.{n}").cast("long").alias(n) for n in ("extracted", "placed", "needs_review")],
    )


@query
def followup_messages(spark, sf_dir):
    return resume_profiles(spark, sf_dir).select(
        "doc_id", rules.followup_message(F.col("profile")).alias("message")
    )


@query
def internal_summary(spark, sf_dir):
    return resume_profiles(spark, sf_dir).select(
        "doc_id", rules.internal_summary(F.col("profile")).alias("summary")
    )


@query
def edit_buffer(spark, sf_dir):
    return edits.buffered_edits(I.edits(spark, sf_dir))


@query
def apply_edits(spark, sf_dir):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = in_buckets(spark, "profiles", artifact_profiles(spark, sf_dir), buckets)
    edited = edits.apply_edits(stored, I.edits(spark, sf_dir), buckets)
    return edited.select("artifact_id", *flat_profile())


@query
def unapplied_edits(spark, sf_dir):
    return edits.unapplied_edits(
        artifact_profiles(spark, sf_dir), I.edits(spark, sf_dir)
    ).select("artifact_id", "path", "value")


@query
def unresolved_missing(spark, sf_dir):
    return edits.remaining_missing(artifact_profiles(spark, sf_dir), I.edits(spark, sf_dir))


@query
def export_gate(spark, sf_dir):
    return edits.export_gate(artifact_profiles(spark, sf_dir), I.edits(spark, sf_dir))


# --- rendering -----------------------------------------------------------------------------
@query
def field_display(spark, sf_dir):
    p = F.col("profile")
    shown = ("location", *C.CONTACT_LABELS, *C.DETAIL_LABELS)
    return reviewed_profiles(spark, sf_dir).select(
        "doc_id", *[rules.field_display(p, name).alias(name) for name in shown]
    )


@query
def headings(spark, sf_dir):
    return contexts(spark, sf_dir).select(
        "doc_id", "context.candidate_heading", "context.candidate_subheading"
    )


@query
def contact_lines(spark, sf_dir):
    named = reviewed_profiles(spark, sf_dir).select(
        "doc_id", render.contact_lines(F.col("profile"), F.lit(False)).alias("lines")
    )
    return named.select("doc_id", list_text(F.col("lines")).alias("lines"))


@query
def blind_contact(spark, sf_dir):
    blind = reviewed_profiles(spark, sf_dir).select(
        "doc_id", render.contact_lines(F.col("profile"), F.lit(True)).alias("lines")
    )
    return blind.select("doc_id", list_text(F.col("lines")).alias("lines"))


@query
def language_lines(spark, sf_dir):
    return contexts(spark, sf_dir).select(
        "doc_id", list_text(F.col("context.languages")).alias("languages")
    )


@query
def render_experience(spark, sf_dir):
    rows = unfold(contexts(spark, sf_dir), "context.work_experience", "doc_id")
    return rows.select(
        "doc_id",
        "item.company",
        "item.title",
        "item.location",
        "item.date_range",
        list_text(F.col("item.description")).alias("description"),
    )


@query
def render_education(spark, sf_dir):
    rows = unfold(contexts(spark, sf_dir), "context.education", "doc_id")
    return rows.select("doc_id", "pos", "item.*")


@query
def render_certs(spark, sf_dir):
    return contexts(spark, sf_dir).select(
        "doc_id", list_text(F.col("context.certifications")).alias("certifications")
    )


@query
def additional_details(spark, sf_dir):
    rows = unfold(contexts(spark, sf_dir), "context.additional_details", "doc_id")
    return rows.select("doc_id", "pos", "item.label", "item.value")


@query
def render_context(spark, sf_dir):
    return contexts(spark, sf_dir).select("doc_id", *flat_context())


# --- templates -----------------------------------------------------------------------------
@query
def blueprint_registry(spark, sf_dir):
    """Registered templates, and how often each id was registered."""
    registered = page_registry(spark, sf_dir)
    twice = blueprints.duplicate_ids(registered)
    joined = registered.join(twice, "template_id", "left")
    normal = F.try_element_at(F.col("typography"), F.lit("normal"))
    return joined.select(
        "path",
        "template_id",
        F.col("version").cast("long").alias("version"),
        "source_reference_type",
        list_text(F.col("source_sha256")).alias("source_sha256"),
        "renderer_key",
        list_text(F.col("section_order")).alias("section_order"),
        F.col("skills_columns").cast("long").alias("skills_columns"),
        F.col("page.width_inches").alias("width_inches"),
        normal["color_hex"].alias("normal_color"),
        F.coalesce("registrations", F.lit(1)).cast("long").alias("registrations"),
    )


@query
def blueprint_checks(spark, sf_dir):
    checked = blueprints.check_blueprints(I.blueprint_payloads(spark, sf_dir))
    return checked.select(
        "path",
        (F.size("violations") == 0).alias("accepted"),
        F.array_join(F.array_sort("violations"), "; ").alias("violations"),
    )


@query
def blueprint_match(spark, sf_dir):
    return matched_uploads(spark, sf_dir).select(
        "artifact_id",
        "sha256",
        "matched_template_id",
        F.col("blueprint_version").cast("long").alias("blueprint_version"),
    )


@query
def target_format_meta(spark, sf_dir):
    meta = blueprints.target_format(matched_uploads(spark, sf_dir))
    return meta.select("target_format.*").withColumn(
        "blueprint_version", F.col("blueprint_version").cast("long")
    )


def _generate_requests(matched):
    """A request per upload; some name an unknown template, most rely on the match."""
    return matched.withColumn(
        "template_name",
        F.expr(
            "CASE WHEN CAST(substring(artifact_id, 11, 18) AS BIGINT) % 7 = 3 THEN 'unknown'"
            " WHEN CAST(substring(artifact_id, 11, 18) AS BIGINT) % 7 = 4 THEN 'page_1' END"
        ),
    )


def _unique_templates(spark, registered):
    """One row per id: the first in path order, as lookups by id take it."""
    return (
        registered
        .unionByName(built_in_registry(spark))
        .groupBy("template_id")
        .agg(
            F.min_by(F.struct("renderer_key", "section_order", "skills_columns"), "path").alias("t")
        )
        .select("template_id", "t.*")
    )


@query
def effective_template(spark, sf_dir):
    registered = kept_once(spark, "registry", page_registry(spark, sf_dir))
    requests = _generate_requests(blueprints.match_blueprints(I.uploads(spark, sf_dir), registered))
    chosen = blueprints.effective_template(requests, _unique_templates(spark, registered))
    return chosen.select(
        "artifact_id",
        "template_id",
        "renderer_key",
        list_text(F.col("section_order")).alias("section_order"),
        F.col("skills_columns").cast("long").alias("skills_columns"),
        "reason",
    )


@query
def target_ref_check(spark, sf_dir):
    """Stored target formats, and requests that tamper with a field, one in eleven each."""
    formats = blueprints.target_format(matched_uploads(spark, sf_dir))
    seed = F.expr("CAST(substring(artifact_id, 11, 18) AS BIGINT) % 11")
    stored = formats.select(
        "artifact_id",
        F.when(seed != 5, F.array(F.col("target_format.stored_filename"))).alias("stored_files"),
        F.when(seed == 6, F.lit("{}"))
        .when(seed != 7, F.to_json("target_format"))
        .alias("metadata_json"),
    )
    t = F.col("target_format")
    sent = formats.select(
        "artifact_id",
        F.when(seed == 1, t.withField("artifact_id", F.lit("artifact_other")))
        .when(seed == 2, t.withField("role", F.lit("html_page")))
        .when(seed == 3, t.withField("download_url", F.lit("/elsewhere")))
        .when(seed == 4, t.withField("note", F.lit("changed")))
        .when(seed == 8, t.withField("matched_template_id", F.lit("page_0")))
        .when(seed == 9, F.lit(None))
        .otherwise(t)
        .alias("target_format"),
    )
    checked = blueprints.check_references(sent, stored)
    return checked.select(
        blueprints.choose_artifact_id(
            F.col("artifact_id"), F.col("target_format.artifact_id")
        ).alias("artifact_id"),
        "reason",
    )


# --- from request to export ------------------------------------------------------------------
def _sent_and_stored(formats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that come with requests, and what is stored; one in eleven each is tampered with."""
    seed = F.expr(f"{I.RULE_SEED.replace('doc_id', 'artifact_id')} % 11")
    t = F.col("target_format")
    stored = formats.select(
        "artifact_id",
        F.when(seed != 5, F.array(t["stored_filename"])).alias("stored_files"),
        F.when(seed == 6, F.lit("{}")).when(seed != 7, F.to_json(t)).alias("metadata_json"),
    )
    sent = formats.select(
        "artifact_id",
        F.when(seed == 1, t.withField("artifact_id", F.lit("artifact_other")))
        .when(seed == 2, t.withField("role", F.lit("html_page")))
        .when(seed == 3, t.withField("download_url", F.lit("/elsewhere")))
        .when(seed == 4, t.withField("note", F.lit("changed")))
        .when(seed == 8, t.withField("matched_template_id", F.lit("page_0")))
        .when(seed == 9, F.lit(None))
        .otherwise(t)
        .alias("target_format"),
    )
    return sent, stored


EXPORT_BUCKETS, ARTIFACTS_A_BUCKET = 16, 50_000


def export_buckets(spark, sf_dir) -> int:
    """EXPORT_BUCKETS, or more where these would hold more than ARTIFACTS_A_BUCKET each."""
    artifacts = I.table(spark, sf_dir, "customer").count()
    return max(EXPORT_BUCKETS, -(-artifacts // ARTIFACTS_A_BUCKET))


@query
def generate_exports(spark, sf_dir):
    """The lines of every customer's request, or the reason for which it is refused."""
    buckets = export_buckets(spark, sf_dir)
    registered = kept_once(spark, "registry", page_registry(spark, sf_dir))
    matched = blueprints.match_blueprints(I.customer_uploads(spark, sf_dir), registered)
    formats = in_buckets(spark, "formats", blueprints.target_format(matched), buckets)
    sent, kept = _sent_and_stored(formats)
    profiles = extract.extract_profiles(I.customer_resumes(spark, sf_dir), "doc_id").select(
        F.col("doc_id").alias("artifact_id"), "profile"
    )
    made = generate.exports(
        I.requests(spark, sf_dir, sent).withColumn("request_id", F.col("artifact_id")),
        in_buckets(spark, "profiles", profiles, buckets),
        I.edits(spark, sf_dir),
        kept,
        _unique_templates(spark, registered),
        buckets,
    )
    told = made.withColumn("open_fields", F.size("open_fields").cast("long"))
    return layout.positions_or_reason(told, "lines", "request_id", "template_id", "open_fields")


# --- layout --------------------------------------------------------------------------------
def _line_rows(df: DataFrame) -> DataFrame:
    return layout.positions(df, "lines", "doc_id")


def _with_template(context_rows: DataFrame, spark: SparkSession, template: str) -> DataFrame:
    """Adds the template an SQL expression names, and its layout columns."""
    asked = context_rows.withColumn("template_name", F.expr(template)).withColumn(
        "matched_template_id", F.lit(None).cast("string")
    )
    return blueprints.effective_template(asked, built_in_registry(spark))


@query
def layout_apex(spark, sf_dir):
    laid = contexts(spark, sf_dir).select(
        "doc_id", layout.apex_lines(F.col("context")).alias("lines")
    )
    return _line_rows(laid)


@query
def layout_classic(spark, sf_dir):
    chosen = _with_template(contexts(spark, sf_dir), spark, "'client_10554236_v1'")
    laid = chosen.select(
        "doc_id",
        layout.classic_lines(
            F.col("context"), F.col("section_order"), F.col("skills_columns")
        ).alias("lines"),
    )
    return _line_rows(laid)


@query
def highlights_grid(spark, sf_dir):
    columns = F.expr(f"CAST(1 + {I.RULE_SEED} % 4 AS INT)")
    grids = contexts(spark, sf_dir).select(
        "doc_id", layout.highlights_grid(F.col("context.skills"), columns).alias("grid")
    )
    return unfold(grids, "grid", "doc_id").select(
        "doc_id",
        F.col("item.grid_row").cast("long").alias("grid_row"),
        F.col("item.grid_column").cast("long").alias("grid_column"),
        "item.text",
    )


@query
def layout_lines(spark, sf_dir):
    """Lines by the template asked for; a request for an unknown one is a row with its reason.

    Every third document asks for the classic template, every seventh for an unknown one.
    """
    template = (
        f"CASE WHEN {I.RULE_SEED} % 7 = 0 THEN 'unknown'"
        f" WHEN {I.RULE_SEED} % 3 = 1 THEN 'client_10554236_v1' END"
    )
    chosen = _with_template(contexts(spark, sf_dir), spark, template)
    refused = chosen.where(F.col("reason").isNotNull()).select(
        "doc_id",
        F.lit(None).cast("long").alias("line_no"),
        F.lit(None).cast("string").alias("section"),
        F.lit("refused").alias("kind"),
        F.col("reason").alias("text"),
    )
    return _line_rows(layout.lay_out(chosen)).unionByName(refused)


# --- artifact state ------------------------------------------------------------------------
def _flat_state(state: DataFrame) -> DataFrame:
    return state.withColumn(
        "missing_field_labels", list_text(F.col("missing_field_labels"))
    ).withColumn("needs_review_count", F.col("needs_review_count").cast("long"))


def _flat_record(records: DataFrame) -> DataFrame:
    return _flat_state(records).withColumn("debug_artifacts", map_text(F.col("debug_artifacts")))


@query
def artifact_state(spark, sf_dir):
    return _flat_state(artifacts.artifact_state(I.artifact_events(spark, sf_dir)))


@query
def debug_artifact_map(spark, sf_dir):
    entries_ = artifacts.debug_entries(I.artifact_events(spark, sf_dir))
    return artifacts.debug_maps(entries_).select(
        "artifact_id", map_text(F.col("debug_artifacts")).alias("debug_artifacts")
    )


@query
def artifact_lookup(spark, sf_dir):
    events = I.artifact_events(spark, sf_dir)
    found = artifacts.lookup(artifacts.artifact_state(events), "artifact_7")
    return _flat_record(artifacts.with_debug_artifacts(found, events))


@query
def recent_artifacts(spark, sf_dir):
    events = I.artifact_events(spark, sf_dir)
    found = artifacts.recent(artifacts.artifact_state(events))
    return _flat_record(artifacts.with_debug_artifacts(found, events))


@query
def artifact_jobs(spark, sf_dir):
    """The stored table after the log was merged in three parts that overlap in time, one of
    them twice."""
    table = JobTable(spark, f"{shared_folder(spark)}/artifact-jobs-{uuid.uuid4().hex}", buckets=16)
    events = I.artifact_events(spark, sf_dir)
    for part in (2, 0, 0, 1):
        table.merge(events.where(F.col("seq") % 3 == part))
    return _flat_record(table.records())


@query
def missing_labels(spark, sf_dir):
    labelled = resume_profiles(spark, sf_dir).select(
        "doc_id", rules.missing_labels(F.col("profile")).alias("labels")
    )
    coded = labelled.select("doc_id", artifacts.labels_to_json(F.col("labels")).alias("json"))
    decoded = artifacts.labels_from_json(F.col("json"))
    return coded.select(
        "doc_id",
        "json",
        list_text(decoded).alias("labels"),
        F.size(decoded).cast("long").alias("needs_review_count"),
    )


@query
def artifact_urls(spark, sf_dir):
    state = artifacts.artifact_state(I.artifact_events(spark, sf_dir)).select("artifact_id")
    a = F.col("artifact_id")
    pdf, docx = F.lit("candidate_profile.pdf"), F.lit("candidate_profile.docx")
    return state.select(
        "artifact_id",
        blueprints.artifact_url(a, docx, download=True).alias("docx_download_url"),
        blueprints.artifact_url(a, pdf, download=True).alias("pdf_download_url"),
        blueprints.artifact_url(a, pdf).alias("pdf_preview_url"),
        blueprints.metadata_url(a).alias("metadata_url"),
    )


@query
def immutable_originals(spark, sf_dir):
    """Originals of the event log stay; of what orders bring, only new artifacts enter."""
    events = I.artifact_events(spark, sf_dir)
    stored = artifacts.first_written(
        events.where(F.col("event_type") == artifacts.PROCESSED), "source_filename"
    )
    incoming = (
        I.table(spark, sf_dir, "orders")
        .groupBy(F.expr("concat('artifact_', o_custkey)").alias("artifact_id"))
        .agg(F.expr("concat('order_', min(o_orderkey), '.docx')").alias("source_filename"))
    )
    new = artifacts.not_yet_stored(incoming, stored, "artifact_id")
    return stored.unionByName(new)


# --- corpus --------------------------------------------------------------------------------
@query
def corpus_failures(spark, sf_dir):
    """Documents and their lines by outcome: good, blank, not readable or of an unknown template."""
    docs = I.corpus_documents(spark, sf_dir).withColumn(
        "error", F.when(~validate.is_accepted_upload(F.col("file")), F.lit(C.NOT_DOCX))
    )
    run = corpus.run_corpus(
        docs, "doc_id", "lang", "wanted", template=F.col("wanted"), problem="error"
    )
    return corpus.failure_counts(run, "lang")


@query
def missing_rate(spark, sf_dir):
    docs = I.spread(I.table(spark, sf_dir, "documents"), "doc_id")
    return corpus.missing_rates(extract.extract_profiles(docs, "doc_id", "lang"), "lang")


@query
def review_histogram(spark, sf_dir):
    counted = corpus.review_histogram(resume_profiles(spark, sf_dir))
    return counted.select(
        F.col("needs_review").cast("long").alias("needs_review"),
        "documents",
        F.round("mean_extracted", 6).alias("mean_extracted"),
    )


def prompt_schema_text() -> str:
    return json.dumps(S.json_schema(S.PROFILE))
