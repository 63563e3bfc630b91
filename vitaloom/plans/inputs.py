"""Inputs that queries derive from the test tables.

The tables hold no résumés, so these are made of their rows. Each derivation is a list of
SQL expressions that Spark and the checking SQL read alike, so both sides start from the
same values; what is computed from them is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A measurement may ask for a number of partitions of its own.
PARTITIONS: int | None = None


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` in as many partitions as the session shuffles into, unless it already lies in as many.

    What is computed from a row here takes up to a millisecond, while rows may compress to a few
    bytes. Files split by size alone would leave millions of rows to one task.
    """
    spark = df.sparkSession
    wanted = PARTITIONS or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if PARTITIONS is None and df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, key)


# --- derived résumés, one per customer: lines joined by line ends -----------------------
# Together they hold every kind of line the extraction knows, and its special cases: a
# blank label value, a value on the next line, a heading with a colon, repeated headings,
# an empty summary, a customer number that reads like a phone number.
RESUME_LINES = (
    "CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE concat('Candidate ', c_mktsegment) END",
    "CASE WHEN c_custkey % 7 <> 6 THEN concat('c', c_custkey, '@example.com') END",
    "CASE WHEN c_custkey % 4 = 0 THEN concat('Phone: +1 (555) 010-', 1000 + c_custkey) END",
    "CASE WHEN c_custkey % 6 = 0 THEN concat('https://www.linkedin.com/in/c', c_custkey) END",
    "CASE WHEN c_custkey % 2 = 0 THEN concat('See (https://github.com/c', c_custkey, ')') END",
    "CASE WHEN c_custkey % 3 <> 0 THEN concat('Location: ', n_name)"
    " WHEN c_custkey % 6 = 3 THEN concat('address :  ', n_name, ' City') END",
    "CASE WHEN c_custkey % 5 = 1 THEN 'Professional Summary:'"
    " WHEN c_custkey % 5 IN (2, 3) THEN 'Summary' END",
    "CASE WHEN c_custkey % 5 IN (1, 3)"
    " THEN concat('  Analyst for the ', c_mktsegment, ' market.  ') END",
    "CASE WHEN c_custkey % 5 = 1 THEN '• Reports weekly' END",
    "CASE WHEN c_custkey % 4 = 1 THEN 'Skills:' ELSE 'Skills' END",
    "concat(c_mktsegment, ', SQL; Python | SQL')",
    "CASE WHEN c_custkey % 5 = 0 THEN 'Notice period: 30 days' END",
    "CASE WHEN c_custkey % 7 = 0 THEN 'SALARY EXPECTATION : 90,000 per year' END",
    "CASE WHEN c_custkey % 8 = 0 THEN 'Work authorization:' END",
    "CASE WHEN c_custkey % 8 = 0 THEN concat('Permit ', n_name) END",
    "CASE WHEN c_custkey % 10 = 0 THEN 'Interview availability: from Monday' END",
    "CASE WHEN c_custkey % 9 = 0 THEN 'Languages: English, French, '"
    " WHEN c_custkey % 9 = 1 THEN 'Languages' END",
    "CASE WHEN c_custkey % 9 = 1 THEN '- English; German' END",
    "CASE WHEN c_custkey % 13 <> 0 THEN"
    " CASE WHEN c_custkey % 2 = 0 THEN 'Experience' ELSE 'Employment History' END END",
    "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Freelance work'"
    " WHEN c_custkey % 3 = 0 THEN concat('Senior Analyst at ', c_mktsegment)"
    " WHEN c_custkey % 3 = 1 THEN concat('Analyst AT ', c_mktsegment, ' (2019 to 2023)')"
    " ELSE concat('- Analyst at ', c_mktsegment, ' (since 2020)') END",
    "CASE WHEN c_custkey % 13 <> 0 THEN '- Built pipelines' END",
    "CASE WHEN c_custkey % 13 <> 0 THEN '* Ran audits' END",
    "CASE WHEN c_custkey % 4 = 2 THEN 'Projects' END",
    "CASE WHEN c_custkey % 4 = 2 THEN 'Ledger; Migration' END",
    "CASE WHEN c_custkey % 6 = 1 THEN 'ACHIEVEMENTS' END",
    "CASE WHEN c_custkey % 6 = 1 THEN concat('Prize | ', n_name) END",
    "'Education'",
    "CASE WHEN c_custkey % 3 = 0 THEN 'MSc Data — Night School'"
    " ELSE 'BSc Economics – Example University (2018)' END",
    "CASE WHEN c_custkey % 8 = 0 THEN 'Diploma' END",
    "'Certifications'",
    "'• CPA'",
    "CASE WHEN c_custkey % 7 = 0 THEN 'SKILLS' END",
    "CASE WHEN c_custkey % 7 = 0 THEN 'Go' END",
)
RESUME_KEY = "concat('c', c_custkey)"
# Some résumés come with other line ends.
RESUME_END = "CASE WHEN c_custkey % 11 = 0 THEN chr(13) || chr(10) ELSE chr(10) END"

# --- derived résumés, one per document: its whole text stands in the summary -------------
DOCUMENT_LINES = (
    "concat('Author of ', source)",
    "concat('Location: ', lang)",
    "'Summary'",
    "text",
    "'Skills'",
    "concat(source, ', SQL; ', lang)",
    "'Experience'",
    "concat('Writer at ', source, ' (2019 to 2023)')",
    "concat('- Wrote ', n_chars, ' characters')",
)
DOCUMENT_KEY = "concat('d', doc_id)"


def customer_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): nation is joined as Spark sees fit; it is a small dimension."""
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey")
    nations = table(spark, sf_dir, "nation")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr(
        f"{RESUME_KEY} AS doc_id", f"concat_ws({RESUME_END}, {', '.join(RESUME_LINES)}) AS text"
    )


def with_blank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, text) of all documents and, for every ninth, a further one of blanks."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "lang", "text")
    blank = docs.where("doc_id % 9 = 4").selectExpr(
        "-1 - doc_id AS doc_id", "lang", "concat(' ', chr(10), '\u3000') AS text"
    )
    return docs.unionByName(blank)


# Documents as a corpus run gets them: some ask for an unknown template, some are files of a
# kind that is not read, and for every ninth there is a further one of blanks.
CORPUS_TEMPLATE = (
    "CASE WHEN doc_id % 8 = 3 THEN 'unknown' WHEN doc_id % 8 = 6 THEN 'client_10554236_v1'"
    " ELSE 'apex_standard' END"
)
CORPUS_FILE = "concat(source, '/', doc_id, CASE WHEN doc_id % 7 = 2 THEN '.odt' ELSE '.docx' END)"


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, wanted, file, text)."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id", "lang", f"{CORPUS_TEMPLATE} AS wanted", f"{CORPUS_FILE} AS file", "text"
    )
    blank = docs.where("doc_id % 9 = 4").selectExpr(
        "-1 - doc_id AS doc_id", "lang", "wanted", "'blank.docx' AS file",
        "concat(' ', chr(10), '\u3000') AS text",
    )
    return docs.unionByName(blank)


def document_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.selectExpr(
        f"{DOCUMENT_KEY} AS doc_id", f"concat_ws(chr(10), {', '.join(DOCUMENT_LINES)}) AS text"
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_resumes(spark, sf_dir).unionByName(document_resumes(spark, sf_dir))


# --- derived reviewer rules: a rule map per résumé, from its key -------------------------
RULE_EXPRS = {
    "location": "CASE WHEN h % 4 = 1 THEN 'hide' WHEN h % 4 = 2 THEN 'available_upon_request' END",
    "email": "CASE WHEN h % 5 = 1 THEN 'hide' WHEN h % 5 = 2 THEN 'pending_confirmation' END",
    "phone": "CASE WHEN h % 3 = 1 THEN 'available_upon_request' END",
    "portfolio_url": "CASE WHEN h % 2 = 0 THEN 'show' END",
    "salary_expectation": "CASE WHEN h % 7 = 1 THEN 'hide' WHEN h % 7 = 2 THEN 'show' END",
    "notice_period": "CASE WHEN h % 6 = 1 THEN 'available_upon_request' END",
    "skills": "CASE WHEN h % 9 = 1 THEN 'pending_confirmation' END",
}
# A number that both engines read off the key.
RULE_SEED = "CAST(substring(doc_id, 2, 18) AS BIGINT)"


def reviewed(profiles: DataFrame) -> DataFrame:
    """Adds `requested`, the rules a reviewer sent, and `blind`."""
    seeded = profiles.withColumn("h", F.expr(RULE_SEED))
    entries = [
        F.when(F.expr(e).isNotNull(), F.struct(F.lit(k).alias("k"), F.expr(e).alias("v")))
        for k, e in RULE_EXPRS.items()
    ]
    return (
        seeded.withColumn(
            "requested", F.map_from_entries(F.array_compact(F.array(*entries)))
        )
        .withColumn("blind", F.expr("h % 2 = 1"))
        .drop("h")
    )


# --- derived artifact events: one per row of `events` ------------------------------------
EVENT_COLUMNS = {
    "artifact_id": "concat('artifact_', user_id)",
    "ts": "ts",
    "seq": "event_id",
    "event_type": "CASE event_type WHEN 'purchase' THEN 'generated'"
    " WHEN 'signup' THEN 'target_format_uploaded' ELSE 'processed' END",
    "artifact_dir": "concat('outputs/artifact_', user_id, '/', k % 3)",
    "source_filename": "concat('resume_', k, CASE WHEN k % 2 = 0 THEN '.docx' ELSE '.pdf' END)",
    "source_file_type": "CASE WHEN k % 2 = 0 THEN 'docx' ELSE 'pdf' END",
    "original_pdf_preview_url": "CASE WHEN k % 3 > 0 THEN"
    " concat('/api/artifacts/artifact_', user_id, '/original_resume_preview.pdf') END",
    "original_preview_error": "CASE WHEN k % 3 = 0 THEN concat('preview failed: ', k) END",
    "target_format_role": "CASE WHEN k % 2 = 0 THEN 'docx_template' ELSE 'pdf_reference' END",
    "target_format_filename": "concat('sample_', k, '.pdf')",
    "target_format_download_url": "concat('/api/artifacts/artifact_', user_id,"
    " CASE WHEN k % 2 = 0 THEN '/target_format_template.docx'"
    " ELSE '/target_format_reference.pdf' END)",
    "template_name": "CASE WHEN k % 4 = 0 THEN 'client_10554236_v1' ELSE 'apex_standard' END",
    "blind_profile": "k % 2 = 1",
    "docx_download_url": "concat('/api/artifacts/artifact_', user_id,"
    " '/candidate_profile.docx?download=1')",
    "pdf_download_url": "concat('/api/artifacts/artifact_', user_id,"
    " '/candidate_profile.pdf?download=1')",
    "pdf_preview_url": "concat('/api/artifacts/artifact_', user_id, '/candidate_profile.pdf')",
}
# Labels of missing fields, as a list with gaps that each engine closes in its own way.
EVENT_LABELS = (
    "CASE WHEN k % 2 = 0 THEN 'Salary expectation' END",
    "CASE WHEN k % 3 = 0 THEN 'Notice period' END",
    "CASE WHEN k % 5 = 0 THEN 'Current location' END",
)
# File role -> condition on the (derived) event type; the location tells the event.
DEBUG_ROLES = {
    "raw_extracted_text": "event_type = 'processed'",
    "candidate_profile": "event_type = 'processed' AND k % 2 = 0",
    "source_resume": "event_type = 'processed' AND k % 3 = 0",
    "target_format": "event_type = 'target_format_uploaded'",
    "export_snapshot": "event_type = 'generated'",
    "generated_pdf": "event_type = 'generated' AND k % 2 = 1",
}
DEBUG_LOCATION = "concat(artifact_dir, '/', '{role}', '_', seq)"


def artifact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    derived = numbered.selectExpr(
        "k", *[f"{expr} AS {name}" for name, expr in EVENT_COLUMNS.items()]
    )
    files = [
        F.when(
            F.expr(condition),
            F.struct(
                F.lit(role).alias("k"),
                F.expr(DEBUG_LOCATION.format(role=role)).alias("v"),
            ),
        )
        for role, condition in DEBUG_ROLES.items()
    ]
    return derived.select(
        *EVENT_COLUMNS,
        F.array_compact(F.array(*[F.expr(e) for e in EVENT_LABELS])).alias(
            "missing_field_labels"
        ),
        F.map_from_entries(F.array_compact(F.array(*files))).alias("debug_artifacts"),
    )


# --- derived edits: one per order, on the résumé of its customer --------------------------
EDIT_PATH = """CASE o_orderkey % 16
 WHEN 0 THEN 'location' WHEN 1 THEN 'salary_expectation' WHEN 2 THEN 'notice_period'
 WHEN 3 THEN 'skills' WHEN 4 THEN 'skills.1' WHEN 5 THEN 'current_title'
 WHEN 6 THEN 'work_experience.0.title' WHEN 7 THEN 'work_experience.0.description.1'
 WHEN 8 THEN 'education.0.degree' WHEN 9 THEN 'languages.0.name'
 WHEN 10 THEN 'certifications.0.issuer' WHEN 11 THEN 'work_authorization'
 WHEN 12 THEN 'interview_availability' WHEN 13 THEN 'email'
 WHEN 14 THEN 'languages.7.name' ELSE 'education.0.end_date' END"""
EDIT_VALUE = """CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 16 = 3
 THEN concat('Edited ', o_orderpriority, ', SQL,, ', o_orderstatus)
 WHEN o_totalprice < 20000 THEN '  ' ELSE concat('Edited ', o_orderkey) END"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_custkey) AS artifact_id",
        f"{EDIT_PATH} AS path",
        f"{EDIT_VALUE} AS value",
        "o_orderkey AS seq",
    )


# --- derived uploads and registry: one upload per page, some pages are registered ---------
UPLOAD_COLUMNS = {
    "artifact_id": "concat('artifact_p', page_id)",
    "input_filename": "concat('Sample ', page_id,"
    " CASE WHEN page_id % 2 = 0 THEN '.DOCX' ELSE '.pdf' END)",
    "content": "html",
}


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.selectExpr(*[f"{e} AS {n}" for n, e in UPLOAD_COLUMNS.items()])


# --- derived requests: one per customer, whose upload is the page of its number ------------
REQUEST_TEMPLATE = (
    "CASE WHEN h % 7 = 3 THEN 'unknown' WHEN h % 7 = 4 THEN 'page_1'"
    " WHEN h % 5 = 2 THEN 'client_10554236_v1' END"
)


def customer_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).withColumn(
        "artifact_id", F.concat(F.lit("c"), F.substring("artifact_id", 11, 18))
    )


def requests(spark: SparkSession, sf_dir: str, sent: DataFrame) -> DataFrame:
    """(artifact_id, requested, blind, template_name, target_format): `sent` holds the record
    each artifact's request comes with."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    ids = spread(customers, "c_custkey").selectExpr(f"{RESUME_KEY} AS doc_id")
    return (
        reviewed(ids)
        .withColumn("h", F.expr(RULE_SEED))
        .withColumnRenamed("doc_id", "artifact_id")
        .withColumn("template_name", F.expr(REQUEST_TEMPLATE))
        .drop("h")
        .join(sent, "artifact_id", "left")
    )


# A blueprint per page as JSON text: most keys hold fixed text, some depend on the page and
# break one rule each.
BLUEPRINT_STYLE = (
    '{"font_name": "Arial", "size_pt": %s, "bold": false, "italic": false,'
    ' "color_hex": "%s", "line_spacing": 1.0, "space_before_pt": 0.0, "space_after_pt": 2}'
)
BLUEPRINT_PARTS = (
    "'{\"template_id\": \"'",
    "CASE WHEN page_id % 23 = 5 THEN 'Page ' WHEN page_id % 6 = 0 THEN 'alt_' ELSE 'page_' END",
    "page_id - CASE WHEN page_id % 17 = 9 THEN 1 ELSE 0 END",
    "'\", \"version\": '",
    "CASE WHEN page_id % 29 = 3 THEN '1.5' WHEN page_id % 29 = 4 THEN '0'"
    " ELSE concat('', 1 + page_id % 3) END",
    "', \"display_name\": \"Page\", \"source_reference_type\": \"'",
    "CASE WHEN page_id % 31 = 2 THEN 'html' WHEN page_id % 4 = 0 THEN 'docx'"
    " ELSE 'pdf_reference' END",
    "'\", \"source_sha256\": [\"'",
    "sha",
    "'\"'",
    "CASE WHEN page_id % 13 = 4 THEN ', \"ABC\"' ELSE '' END",
    "'], \"renderer_key\": \"'",
    "CASE WHEN page_id % 3 = 0 THEN 'classic_10554236' ELSE 'apex_standard' END",
    "'\", \"page\": {\"width_inches\": '",
    "CASE WHEN page_id % 19 = 6 THEN '0' WHEN page_id % 19 = 7 THEN '\"8\"' ELSE '8.27' END",
    "', \"height_inches\": 11.69, \"top_margin_inches\": 0.5, \"right_margin_inches\": 0.5,"
    " \"bottom_margin_inches\": 0.5, \"left_margin_inches\": 0.5,"
    " \"header_distance_inches\": 0, \"footer_distance_inches\": 0.2}, \"typography\": {'",
    "'\"normal\": " + BLUEPRINT_STYLE % ("10", "#00ff00") + ", '",
    "'\"title\": " + BLUEPRINT_STYLE % ("12.5", "000000") + ", '",
    "CASE WHEN page_id % 37 = 8 THEN '' ELSE '\"section\": "
    + BLUEPRINT_STYLE % ("10", "203452")
    + ", ' END",
    "'\"entry_heading\": " + BLUEPRINT_STYLE % ("10", "000000") + "}, \"section_order\": [\"header\"'",
    "CASE WHEN page_id % 2 = 0 THEN ', \"skills\", \"summary\"' ELSE ', \"highlights\"' END",
    "CASE WHEN page_id % 41 = 1 THEN ', \"footer\"' ELSE '' END",
    "'], \"field_mappings\": {}, \"skills_columns\": '",
    "1 + page_id % 5",
    "', \"bullet_left_indent_inches\": 0.25, \"bullet_hanging_indent_inches\": 0.14,"
    " \"overflow\": {\"allow_automatic_page_breaks\": true,"
    " \"keep_experience_heading_with_first_bullet\": true,"
    " \"keep_section_heading_with_next\": true, \"widow_control\": true,"
    " \"split_long_experience_entries\": true'",
    "CASE WHEN page_id % 11 = 3 THEN ', \"surprise\": 1' ELSE '' END",
    "'}'",
    "CASE WHEN page_id % 43 = 2 THEN '' ELSE '}' END",
)
# A page's own fingerprint, or for every sixth page that of the page before, which is then
# registered twice for one source type where the types agree.
BLUEPRINT_SOURCE = "page_id - CASE WHEN page_id % 6 = 0 THEN 4 ELSE 0 END"


def blueprint_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, page_id, payload): registry files derived from pages.

    `sha` joins in the fingerprint of the page that a blueprint names as its source.
    """
    hashed = table(spark, sf_dir, "pages").select(
        "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha")
    )
    pages = spread(hashed, "page_id")
    named = pages.select("page_id", F.expr(BLUEPRINT_SOURCE).alias("source_id"))
    joined = named.join(
        pages.withColumnsRenamed({"page_id": "source_id"}), "source_id"
    )
    return joined.selectExpr(
        "page_id",
        "concat(CASE WHEN page_id % 6 = 0 THEN 'alt_' ELSE 'page_' END, page_id) AS path",
        f"concat({', '.join(BLUEPRINT_PARTS)}) AS payload",
    )


# --- derived profile payloads: JSON text per customer, many of them broken in one place ---
PAYLOAD_PARTS = (
    "CASE WHEN c_custkey % 13 = 1 THEN 'Here is the profile: ' ELSE '' END",
    "'{\"full_name\": \" '",
    "c_name",
    "' \", \"email\": '",
    "CASE WHEN c_custkey % 17 = 2 THEN '5' WHEN c_custkey % 17 = 3 THEN 'null'"
    " ELSE concat('\"c', c_custkey, '@example.com\"') END",
    "', \"location\": \"'",
    "n_name",
    "'\", \"portfolio_url\": '",
    "CASE WHEN c_custkey % 19 = 4 THEN '\"ftp://example.com/a\"'"
    " WHEN c_custkey % 19 = 5 THEN 'null' ELSE '\"https://example.com/a\"' END",
    "', \"skills\": '",
    "CASE WHEN c_custkey % 23 = 6 THEN '\"SQL\"' WHEN c_custkey % 23 = 7 THEN '[\"SQL\", null]'"
    " ELSE concat('[\"', c_mktsegment, '\", \" SQL \", \"\", \"SQL\"]') END",
    "', \"languages\": [{\"name\": \"English\"}'",
    "CASE WHEN c_custkey % 29 = 8 THEN ', {\"proficiency\": \"basic\"}'"
    " WHEN c_custkey % 29 = 9 THEN ', {\"name\": \"French\", \"level\": \"B1\"}' ELSE '' END",
    "'], \"work_experience\": [{\"company\": \"Acme\", \"description\": [\"Built\", \" \"]'",
    "CASE WHEN c_custkey % 31 = 1 THEN ', \"salary\": 1' ELSE '' END",
    "'}], \"certifications\": [], \"client_display_rules\": {\"email\": \"'",
    "CASE WHEN c_custkey % 37 = 2 THEN 'secret' ELSE 'hide' END",
    "'\"}'",
    "CASE WHEN c_custkey % 41 = 3 THEN ', \"age\": 30, \"zodiac\": null' ELSE '' END",
    "CASE WHEN c_custkey % 43 = 4 THEN '' ELSE '}' END",
    "CASE WHEN c_custkey % 13 = 1 THEN ' Done.' WHEN c_custkey % 47 = 5 THEN ' {}' ELSE '' END",
)
PAYLOAD_TEXT = (
    "CASE WHEN c_custkey % 53 = 6 THEN 'no profile found' WHEN c_custkey % 53 = 7 THEN '[1]' ELSE "
    f"concat({', '.join(PAYLOAD_PARTS)}) END"
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey")
    nations = table(spark, sf_dir, "nation")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr(f"{RESUME_KEY} AS doc_id", f"{PAYLOAD_TEXT} AS raw_response")
