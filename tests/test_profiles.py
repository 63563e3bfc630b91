import json

import pytest
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions import rules
from vitaloom.operators import corpus, extract, render, review, validate


def conform(spark, *payloads):
    """Rows of conform_profiles for JSON texts (or Python values)."""
    raws = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    df = spark.createDataFrame(list(enumerate(raws)), "doc_id int, raw_response string")
    return validate.conform_profiles(validate.parse_payloads(df)).orderBy("doc_id").collect()


def profile_table(spark, *payloads):
    raws = [(i, json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(raws, "doc_id int, raw_response string")
    parsed = validate.conform_profiles(validate.parse_payloads(df))
    return parsed.select("doc_id", "profile")


def context(spark, payload, blind=False):
    table = render.with_context(profile_table(spark, payload), blind)
    return table.select("context").first()[0]


@pytest.mark.parametrize(
    "raw, name, reason",
    [
        ('{"full_name": "Ann"}', "Ann", None),
        ('Sure: {"full_name": "Ann"} done', "Ann", None),
        ('```json\n{"full_name": "Ann",\n"skills": []}\n```', "Ann", None),
        ('{"full_name": "Ann"} {"a": 1}', None, validate.BAD_JSON),
        ('{"full_name": "Ann"}], [{"x": 1}', None, validate.BAD_JSON),
        ("nothing here", None, validate.NO_JSON),
        ("", None, validate.NO_JSON),
        ("[1]", None, "payload: not an object"),
        ("null", None, "payload: not an object"),
    ],
)
def test_payload_parsing(spark, raw, name, reason):
    (row,) = conform(spark, raw)
    assert row.reason == reason
    assert (row.profile.full_name if row.profile else None) == name


@pytest.mark.parametrize(
    "payload, reason",
    [
        ({"unexpected": 1, "also": 2}, "also: unknown key; unexpected: unknown key"),
        ({"full_name": 5}, "full_name: not a string"),
        ({"skills": None}, "skills: not a list"),
        ({"skills": ["a", 1]}, "skills.1: not a string"),
        ({"languages": [{"proficiency": "x"}]}, "languages.0.name: required"),
        ({"languages": ["English"]}, "languages.0: not an object"),
        ({"work_experience": [{"description": [None]}]},
         "work_experience.0.description.0: not a string"),
        ({"missing_fields": [{"field_name": "a", "label": "b"}]},
         "missing_fields.0.reason: required"),
        ({"client_display_rules": {"email": "maybe"}},
         "client_display_rules.email: not an allowed value"),
        ({"client_display_rules": {"email": " hide "}},
         "client_display_rules.email: not an allowed value"),
        ({"linkedin_url": "linkedin.com/in/a"}, "linkedin_url: not an http(s) URL"),
        ({"portfolio_url": "ftp://a.b/c"}, "portfolio_url: not an http(s) URL"),
    ],
)
def test_violations(spark, payload, reason):
    (row,) = conform(spark, payload)
    assert row.reason == reason and row.profile is None


def test_conforming_payload_is_trimmed_and_completed(spark):
    (row,) = conform(
        spark,
        {
            "full_name": "  Ann　",
            "location": " ",
            "notice_period": "1 month",
            "skills": [" SQL ", ""],
            "client_display_rules": {"salary_expectation": "available_upon_request"},
        },
    )
    p = row.profile
    assert row.reason is None
    assert p.full_name == "Ann" and p.location == "" and p.skills == ["SQL", ""]
    assert p.languages == [] and p.email is None
    assert [m.field_name for m in p.missing_fields] == [
        "salary_expectation", "work_authorization", "location", "interview_availability",
    ]
    assert [m.label for m in p.missing_fields][2] == "Current location"
    assert p.client_display_rules == {
        "salary_expectation": "available_upon_request",
        "work_authorization": "pending_confirmation",
        "location": "pending_confirmation",
        "interview_availability": "pending_confirmation",
    }


def test_split_loses_nothing(spark):
    df = spark.createDataFrame(
        [(1, "{}"), (2, "x"), (3, '{"a": 1}')], "doc_id int, raw_response string"
    )
    result = validate.conform_profiles(validate.parse_payloads(df))
    assert validate.good(result).count() == 1
    assert validate.rejected(result).count() == 2


def test_filled_field_keeps_its_rule(spark):
    table = profile_table(
        spark,
        {"location": "Rome", "client_display_rules": {"location": "pending_confirmation"}},
    )
    sent = table.withColumn("requested", F.create_map(F.lit("email"), F.lit("hide")))
    p = review.with_requested_rules(sent).first().profile
    assert p.client_display_rules["location"] == "pending_confirmation"
    assert p.client_display_rules["email"] == "hide"
    shown = sent.select(rules.field_display(F.col("profile"), "location")).first()[0]
    assert shown == C.PENDING_TEXT


def test_normalized(spark):
    p = review.normalized(profile_table(spark, {"skills": ["b", "", "a", "b"]})).first().profile
    assert p.skills == ["b", "a"]


def test_ledger_counts_leaves(spark):
    table = profile_table(
        spark,
        {
            "full_name": "Ann",
            "location": "Rome",
            "email": "",
            "skills": ["a", " ", "b"],
            "languages": [{"name": "English", "proficiency": "Fluent"}],
            "work_experience": [{"title": "Cook", "description": ["x", "y"]}],
            "certifications": [{"name": "CPA"}],
        },
        {},
    )
    rows = table.select("doc_id", rules.ledger(F.col("profile")).alias("l")).orderBy("doc_id")
    first, second = [r.l for r in rows.collect()]
    assert (first.extracted, first.placed, first.needs_review) == (10, 10, 4)
    assert (second.extracted, second.needs_review) == (0, 5)


def test_messages(spark):
    table = profile_table(
        spark,
        {},
        {
            "full_name": "Ann", "salary_expectation": "1", "notice_period": "1",
            "work_authorization": "1", "location": "1", "interview_availability": "1",
        },
    )
    p = F.col("profile")
    rows = table.orderBy("doc_id").select(
        rules.followup_message(p).alias("m"), rules.internal_summary(p).alias("s")
    ).collect()
    assert rows[0].m.startswith("Hi there,\n\nThanks for sharing your CV. Could you")
    assert "\n- Availability for interviews\n\nBest,\n" in rows[0].m
    assert rows[0].s.startswith("Candidate: Unknown\n\nMissing information:\n- Salary expectation")
    assert rows[1].m.startswith("Hi Ann,\n\nThanks for sharing your CV. I have everything")
    assert rows[1].s == "Candidate: Ann\n\nMissing information:\n- None\n"


def test_each_detail_follows_its_own_rule(spark):
    """Details in fixed order: pending, shown with a rule, shown without one, on request."""
    details = ("salary_expectation", "notice_period", "work_authorization", "interview_availability")
    ruled = {"notice_period": "show", "interview_availability": "available_upon_request",
             "work_authorization": "pending_confirmation"}
    values = dict(zip(details, ("70,000 EUR", "six weeks", "EU permit", "after 6 pm")))
    c = context(spark, {**values, "client_display_rules": ruled})
    assert [(d.label, d.value) for d in c.additional_details] == [
        (C.DETAIL_LABELS["salary_expectation"], "70,000 EUR"),
        (C.DETAIL_LABELS["notice_period"], "six weeks"),
        (C.DETAIL_LABELS["work_authorization"], C.PENDING_TEXT),
        (C.DETAIL_LABELS["interview_availability"], C.ON_REQUEST_TEXT),
    ]
    hidden = context(spark, {**values, "client_display_rules": dict.fromkeys(details, "hide")})
    assert hidden.additional_details == []


TOMASZ = {
    "full_name": "Tomasz Wolny",
    "email": "tw@poczta.example",
    "phone": "0048 22 000 11 22",
    "location": "Gdynia",
    "linkedin_url": "https://www.linkedin.com/in/twolny",
    "portfolio_url": "http://wolny.example/ships",
    "work_experience": [
        {"company": "Stocznia", "title": "Welder"}, {"company": "Port", "title": "Docker"},
    ],
}


def test_what_a_blind_profile_shows(spark):
    open_, blind = context(spark, TOMASZ), context(spark, TOMASZ, blind=True)
    assert open_.candidate_heading == "Tomasz Wolny" and len(open_.contact_lines) == 5
    assert blind.candidate_heading == C.BLIND_HEADING
    assert blind.candidate_subheading == open_.candidate_subheading == "Welder | Gdynia"
    assert blind.contact_lines == [x for x in open_.contact_lines if "Gdynia" in x]
    for rule, shown in (("show", 2), ("hide", 1), ("available_upon_request", 1)):
        ruled = {**TOMASZ, "client_display_rules": {"portfolio_url": rule}}
        assert len(context(spark, ruled, blind=True).contact_lines) == shown


@pytest.mark.parametrize("rule", [None, *C.DISPLAY_RULES])
@pytest.mark.parametrize("value", [None, "Oslo"])
@pytest.mark.parametrize("blind", [True, False])
def test_rule_matrix(spark, rule, value, blind):
    payload = {"email": value, "client_display_rules": {"email": rule} if rule else {}}
    c = context(spark, payload, blind)
    expected = {
        "hide": None,
        "pending_confirmation": "Email: To be confirmed",
        "available_upon_request": "Email: Available upon request",
    }.get(rule, f"Email: {value}" if value else None)
    lines = [x for x in c.contact_lines if x.startswith("Email")]
    assert lines == ([expected] if expected and not blind else [])


def test_blanks_in_lists_and_records(spark):
    c = context(
        spark,
        {
            "skills": ["\t", "Welding", "", "Tides "],
            "languages": [{"name": "\u3000", "proficiency": "C1"}, {"name": "Kashubian"}],
            "work_experience": [
                {"company": " ", "title": "Welder", "end_date": "June", "description": ["\n", "Hulls"]},
                {"company": "Port", "start_date": "1999", "end_date": "\t"},
            ],
            "certifications": [{"name": "TIG", "issuer": "DVS", "date": ""}],
        },
    )
    assert [s.strip() for s in c.skills] == ["Welding", "Tides"]
    assert c.languages[-1] == "Kashubian"
    assert [(e.company, e.date_range) for e in c.work_experience] == [(None, "June"), ("Port", "1999")]
    assert c.work_experience[0].description == ["Hulls"]
    assert c.certifications == ["TIG | DVS"]
    # A missing location shows as to be confirmed.
    assert c.candidate_subheading == f"Welder | {C.PENDING_TEXT}"


def test_corpus_run_keeps_every_document(spark):
    docs = spark.createDataFrame(
        [(1, "en", "Ann\nSkills: SQL"), (2, "en", " 　\n"), (3, "de", None)],
        "doc_id int, lang string, text string",
    )
    run = corpus.run_corpus(docs, "doc_id", "lang")
    rows = {r.doc_id: r for r in run.collect()}
    assert rows[1].context.candidate_heading == "Candidate A" and rows[1].reason is None
    assert rows[2].profile is None and rows[3].reason == validate.EMPTY_TEXT
    found = corpus.failure_counts(run, "lang").collect()
    counts = {(r.lang, r.reason): r.documents for r in found}
    assert {(r.lang, r.reason): r.lines for r in found if r.lines} == {("en", None): rows[1].n_lines}
    assert counts == {
        ("en", None): 1, ("en", validate.EMPTY_TEXT): 1, ("de", validate.EMPTY_TEXT): 1,
    }


def test_corpus_run_extracts_validates_and_lays_out(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "apex_standard", "Ann\nSkills: SQL"), (2, "nothing", "Bob\nSkills: SQL"), (3, "nothing", " ")],
        "doc_id int, wanted string, text string",
    )
    run = corpus.run_corpus(docs, "doc_id", "wanted", template=F.col("wanted"))
    rows = {r.doc_id: r for r in run.collect()}
    assert rows[1].reason is None and rows[1].n_lines > 3
    assert rows[2].reason == "Unknown target format blueprint: nothing" and rows[2].context is None
    assert rows[3].reason == validate.EMPTY_TEXT
    # A profile that breaks the schema, as an extractor of other links would yield it.
    real = corpus.extract_profiles
    monkeypatch.setattr(corpus, "extract_profiles", lambda *args: real(*args).withColumn(
        "profile", F.col("profile").withField("portfolio_url", F.lit("ftp://x"))
    ))
    broken = {r.doc_id: r.reason for r in corpus.run_corpus(docs, "doc_id").collect()}
    assert "portfolio_url" in broken[1] and broken[3] == validate.EMPTY_TEXT


def test_corpus_run_takes_what_the_source_says_first(spark):
    docs = spark.createDataFrame(
        [(1, "Ann", None), (2, "Bob", "no such kind"), (3, None, "not to be opened"), (4, " ", None)],
        "doc_id int, text string, error string",
    )
    run = corpus.run_corpus(docs, "doc_id", problem="error")
    reasons = {r.doc_id: r.reason for r in run.collect()}
    assert reasons == {1: None, 2: "no such kind", 3: "not to be opened", 4: validate.EMPTY_TEXT}


def test_file_name_checks(spark):
    names = ["a.docx", "A.PDF", ".pdf", "x.docx.txt", "b.", "dir.pdf/a", "ü 1.DocX"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n",
        validate.suffix(F.col("n")).alias("s"),
        validate.is_accepted_upload(F.col("n")).alias("ok"),
    ).collect()
    assert [r.n for r in rows if r.ok] == ["a.docx", "A.PDF", "ü 1.DocX"]
    ids = ["artifact_1", "ä-1", "", "a\n", "a b", "a/b", None, "²"]
    safe = spark.createDataFrame([(i,) for i in ids], "i string").select(
        validate.is_safe_artifact_id(F.col("i"))
    ).collect()
    assert [s[0] for s in safe] == [True, True, False, False, False, False, False, True]


def test_profile_schema_is_what_extraction_yields(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    profile = extract.extract_profiles(docs, "doc_id").schema["profile"].dataType
    assert profile.simpleString() == S.PROFILE.simpleString()
