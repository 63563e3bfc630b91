import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.operators import blueprints, layout, render
from vitaloom.sources.tables import load_blueprints
from vitaloom.templates import BUILT_IN, built_in_registry
from tests.test_profiles import profile_table

CONTENT = b"synthetic target reference"


def check(spark, payload):
    df = spark.createDataFrame([("p", json.dumps(payload))], "path string, payload string")
    return blueprints.check_blueprints(df).select("violations").first()[0]


def changed(**changes):
    payload = copy.deepcopy(BUILT_IN[1])
    for path, value in changes.items():
        *parents, last = path.split("__")
        at = payload
        for name in parents:
            at = at[name]
        if value is KeyError:
            del at[last]
        else:
            at[last] = value
    return payload


def write_registry(folder, *payloads):
    for i, payload in enumerate(payloads):
        (folder / f"t{i}").mkdir()
        (folder / f"t{i}" / "blueprint.json").write_text(json.dumps(payload))


def test_registry(spark, tmp_path):
    write_registry(tmp_path, *BUILT_IN)
    rows = {r.template_id: r for r in load_blueprints(spark, str(tmp_path)).collect()}
    assert set(rows) == {"apex_standard", "client_10554236_v1"}
    classic = rows["client_10554236_v1"]
    assert (classic.version, classic.source_reference_type) == (1, "pdf_reference")
    assert (classic.renderer_key, classic.skills_columns) == ("classic_10554236", 2)
    assert classic.page.width_inches == pytest.approx(8.2639)
    assert {s.color_hex for s in classic.typography.values()} == {"000000"}
    built_in = {r.template_id: r for r in built_in_registry(spark).collect()}
    assert built_in["client_10554236_v1"].section_order == classic.section_order


def test_registry_refuses_duplicates_and_bad_files(spark, tmp_path):
    twice, bad = tmp_path / "twice", tmp_path / "bad"
    twice.mkdir(), bad.mkdir()
    write_registry(twice, BUILT_IN[0], BUILT_IN[0])
    with pytest.raises(ValueError, match="Duplicate target format blueprint: apex_standard"):
        load_blueprints(spark, str(twice))
    write_registry(bad, {**BUILT_IN[0], "unexpected": True})
    with pytest.raises(ValueError, match="unexpected: unknown key"):
        load_blueprints(spark, str(bad))


@pytest.mark.parametrize(
    "changes, violations",
    [
        ({}, []),
        ({"typography__title__color_hex": "#ABCdef", "page__width_inches": 8}, []),
        ({"typography__title__bold": KeyError, "source_sha256": KeyError}, []),
        ({"template_id": "-x"}, ["template_id: not a template id"]),
        ({"version": 1.0}, ["version: not a whole number"]),
        ({"version": True}, ["version: not a whole number"]),
        ({"version": 0}, ["version: must be at least 1"]),
        ({"page__height_inches": 0}, ["page.height_inches: must be positive"]),
        ({"page__left_margin_inches": -1}, ["page.left_margin_inches: must not be negative"]),
        ({"page__width_inches": KeyError}, ["page.width_inches: required"]),
        ({"typography__normal": KeyError}, ["typography.normal: required"]),
        ({"typography__normal__color_hex": "##12345"},
         ["typography.normal.color_hex: not six hex digits"]),
        ({"source_sha256": ["A" * 64]}, ["source_sha256.0: not a lower-case SHA-256"]),
        ({"section_order": ["header", "footer"]}, ["section_order.1: not an allowed value"]),
        ({"renderer_key": "other"}, ["renderer_key: not an allowed value"]),
        ({"skills_columns": 5}, ["skills_columns: must be between 1 and 4"]),
        ({"overflow__widow_control": "yes"}, ["overflow.widow_control: not a boolean"]),
        ({"overflow__more": True}, ["overflow.more: unknown key"]),
    ],
)
def test_blueprint_checks(spark, changes, violations):
    assert check(spark, changed(**changes)) == violations


def matched(spark, *uploads, also=()):
    sha = hashlib.sha256(CONTENT).hexdigest()
    payloads = [
        ("b/x", changed(source_sha256=["0" * 64, sha])),
        ("a/y", changed(source_sha256=[sha], source_reference_type="docx", template_id="in_docx")),
        *also,
    ]
    files = spark.createDataFrame(
        [(p, json.dumps(b)) for p, b in payloads], "path string, payload string"
    )
    registered = blueprints.registry(blueprints.check_blueprints(files))
    df = spark.createDataFrame(
        list(uploads), "artifact_id string, input_filename string, content binary"
    )
    return blueprints.match_blueprints(df, registered)


def test_match_needs_fingerprint_and_type(spark):
    sha = hashlib.sha256(CONTENT).hexdigest()
    rows = matched(
        spark,
        ("a", "x.PDF", CONTENT),
        ("b", "x.docx", CONTENT),
        ("c", "x.pdf", b"other"),
        also=[("a/first", changed(source_sha256=[sha], template_id="earlier"))],
    ).collect()
    assert {r.artifact_id: r.matched_template_id for r in rows} == {
        "a": "earlier", "b": "in_docx", "c": None,
    }


def test_target_format_records(spark):
    uploads = matched(spark, ("a", "x.PDF", CONTENT), ("b", "y.docx", CONTENT), ("c", "z.docx", b"o"))
    meta = {r.artifact_id: r.target_format for r in blueprints.target_format(uploads).collect()}
    assert meta["a"].role == "pdf_reference" and not meta["a"].used_as_template_source
    assert meta["a"].format_support == "manual_blueprint" and meta["a"].input_type == "pdf"
    assert "registered blueprint client_10554236_v1 version 1." in meta["a"].note
    assert meta["b"].used_as_template_source and meta["b"].blueprint_version == 1
    assert meta["c"].generation_strategy == "controlled_docx_renderer"
    assert meta["c"].download_url == "/api/artifacts/c/target_format_template.docx"
    assert meta["c"].note == C.NOTE_DOCX and meta["c"].matched_template_id is None


def test_effective_template(spark):
    requests = spark.createDataFrame(
        [("a", "client_10554236_v1", "apex_standard"), ("b", "", "client_10554236_v1"),
         ("c", None, None), ("d", None, "nope")],
        "artifact_id string, matched_template_id string, template_name string",
    )
    rows = blueprints.effective_template(requests, built_in_registry(spark)).collect()
    assert {r.artifact_id: (r.template_id, r.reason) for r in rows} == {
        "a": ("client_10554236_v1", None),
        "b": ("client_10554236_v1", None),
        "c": ("apex_standard", None),
        "d": ("nope", "Unknown target format blueprint: nope"),
    }


def test_reference_checks(spark):
    formats = blueprints.target_format(matched(spark, ("a", "x.pdf", CONTENT)))
    good = formats.first().target_format.asDict()
    text = json.dumps(good)
    stored_name = [good["stored_filename"]]
    schema = f"artifact_id string, target_format {S.TARGET_FORMAT.simpleString()}"
    cases = [
        (good, stored_name, text, None),
        ({**good, "artifact_id": "b"}, stored_name, text, C.REF_ID_MISMATCH),
        ({**good, "role": "docx_template"}, stored_name, text, C.REF_INVALID),
        ({**good, "download_url": "/x"}, stored_name, text, C.REF_INVALID),
        (good, [], text, C.REF_NOT_UPLOADED),
        (good, stored_name, None, C.REF_METADATA_MISSING),
        (good, stored_name, '{"artifact_id": "a"}', C.REF_METADATA_INVALID),
        (good, stored_name, "nonsense", C.REF_METADATA_INVALID),
        ({**good, "note": "x"}, stored_name, text, C.REF_METADATA_DIFFERS),
        ({**good, "blueprint_version": None}, stored_name, text, C.REF_METADATA_DIFFERS),
        (None, [], None, None),
    ]
    for sent, files, metadata, reason in cases:
        requests = spark.createDataFrame([("a", sent)], schema)
        stored = spark.createDataFrame(
            [("a", files, metadata)],
            "artifact_id string, stored_files array<string>, metadata_json string",
        )
        assert blueprints.check_references(requests, stored).first().reason == reason


def test_new_artifact_id(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), (None, None)], "r string, t string").select(
        blueprints.choose_artifact_id(F.col("r"), F.col("t"))
    ).collect()
    assert [r[0] for r in rows[:2]] == ["a", "b"]
    assert rows[2][0].startswith("artifact_") and len(rows[2][0]) == len("artifact_") + 32


def lay_out(spark, payload, template, blind=False):
    table = render.with_context(profile_table(spark, payload), blind)
    asked = table.withColumn("matched_template_id", F.lit(None).cast("string")).withColumn(
        "template_name", F.lit(template)
    )
    chosen = blueprints.effective_template(asked, built_in_registry(spark))
    rows = layout.positions(layout.lay_out(chosen), "lines", "doc_id").orderBy("line_no").collect()
    return [(r.section, r.kind, r.text) for r in rows]


WELDER = {
    "full_name": "Okoro Bright",
    "location": "Lagos",
    "professional_summary": "Joins steel.",
    "skills": ["TIG", "MIG", "Rigging", "Blueprints", "Crane"],
    "work_experience": [
        {"company": "Dock Nine", "title": "Welder", "location": "Apapa", "start_date": "May 2018",
         "end_date": "Jan 2023", "description": ["Built hulls.", "Trained two."]},
        {"company": "Yard", "description": []},
    ],
    "education": [{"institution": "Trade School", "degree": "Diploma", "end_date": "2017"}],
    "client_display_rules": {"salary_expectation": "hide", "notice_period": "available_upon_request",
                             "work_authorization": "hide", "interview_availability": "hide"},
}


def test_apex_layout(spark):
    lines = lay_out(spark, WELDER, "apex_standard")
    texts = [text for _, _, text in lines]
    assert texts[:3] == ["Candidate Profile", "Okoro Bright", "Welder | Lagos"]
    assert texts[texts.index("Skills") + 1 :][:5] == WELDER["skills"]
    at = texts.index("Work Experience")
    assert texts[at + 1 : at + 5] == [
        "Welder | Dock Nine | May 2018 - Jan 2023", "Apapa", "Built hulls.", "Trained two.",
    ]
    assert texts[-2:] == ["Additional Details", "Notice period: Available upon request"]
    assert {k for s, k, _ in lines if s == "skills"} == {"section_heading", "bullet"}


def test_classic_layout(spark):
    texts = [text for _, _, text in lay_out(spark, WELDER, "client_10554236_v1")]
    assert texts[:4] == ["WELDER", "Summary", "Joins steel.", "Highlights"]
    # Five skills in two columns: rows of the grid, filled column by column.
    assert texts[4:9] == ["TIG", "Blueprints", "MIG", "Crane", "Rigging"]
    assert "Dock Nine May 2018 to Jan 2023 Welder" in texts and "Apapa" in texts
    assert "Trade School 2017 Diploma" in texts and "Contact" not in texts
    assert texts[-2:] == ["Skills", "TIG; MIG; Rigging; Blueprints; Crane."]
    # Without a title and a location the header shows that one is pending.
    assert lay_out(spark, {}, "client_10554236_v1")[0][2] == "TO BE CONFIRMED"


def test_unknown_template_is_refused(spark):
    assert lay_out(spark, WELDER, "nobody_knows") == []


@pytest.mark.parametrize("n", range(0, 8))
@pytest.mark.parametrize("columns", [1, 2, 3, 4])
def test_grid_is_filled_by_column(spark, n, columns):
    skills = [f"s{i}" for i in range(n)]
    df = spark.createDataFrame([(skills,)], "skills array<string>")
    grid = df.select(layout.highlights_grid(F.col("skills"), F.lit(columns))).first()[0]
    used = min(columns, max(1, n))
    height = -(-n // used)
    places = [(r, c) for c in range(used) for r in range(height)][:n]
    assert [(g.grid_row, g.grid_column, g.text) for g in grid] == [
        (r, c, s) for (r, c), s in zip(places, skills)
    ]


SHORT = {"full_name": "Sam Short", "skills": ["Filing"]}
TYPICAL = {
    "full_name": "Tea Typical",
    "location": "Boston",
    "professional_summary": "Accountant with reporting experience.",
    "skills": ["Ledgers", "Audits", "ERP"],
    "languages": [{"name": "English", "proficiency": "Native"}],
    "work_experience": [
        {"company": "Acme", "title": "Accountant", "start_date": "2019", "end_date": "2023",
         "description": ["Closed books.", "Ran audits."]}
    ],
    "education": [{"institution": "State U", "degree": "BSc", "end_date": "2018"}],
    "certifications": [{"name": "CPA", "issuer": "Board"}],
}
LONG = {
    **TYPICAL,
    "full_name": "Lou Long",
    "skills": [f"Skill {i}" for i in range(41)],
    "work_experience": [
        {"company": f"Company {i}", "title": f"Title {i}", "location": f"City {i}",
         "start_date": str(1980 + i), "description": [f"Task {i}.{j}" for j in range(12)]}
        for i in range(15)
    ],
}


@pytest.mark.parametrize("template", ["apex_standard", "client_10554236_v1"])
@pytest.mark.parametrize("payload", [SHORT, TYPICAL, LONG])
def test_profiles_of_any_length_come_out_whole(spark, payload, template):
    texts = [text for _, _, text in lay_out(spark, payload, template)]
    page = "\n".join(texts)
    for skill in payload["skills"]:
        assert skill in page
    for job in payload.get("work_experience", []):
        assert job["company"] in page and job["title"] in page
        at = [texts.index(task) for task in job["description"]]
        assert at == list(range(at[0], at[0] + len(at)))
    if payload is not SHORT:
        assert "CPA | Board" in texts and payload["professional_summary"] in texts
