import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.functions import sections
from vitaloom.functions import text as tx
from vitaloom.operators import extract

BARE = "Okoro Bright\nSKILLS : Welding\nLocation:\tLagos | port\nmail o.bright@yard.example.org now\n"
SHIPYARD = """Ilse van der Meer
Location: Delft
reach me: ilse@harbour.example.net or +31 20 555 0199
SUMMARY:
Keeps cranes running.
Second line of it.
Skills
• Hydraulics; Rigging | PLC
Employment History
Crane Technician at Noordkade BV (Mar 2015 to Jun 2021)
* Cut downtime
Ran night shifts
Projects
• Quay 4 rebuild
Achievements
Safety award; Patent
Education
MEng Mechatronics — TU Delft (2014)
"""


def profiles(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = extract.extract_profiles(docs, "doc_id").orderBy("doc_id").collect()
    return [r.profile for r in rows]


def profile(spark, text):
    return profiles(spark, text)[0]


def test_text_without_sections(spark):
    p = profile(spark, BARE)
    assert (p.full_name, p.email) == ("Okoro Bright", "o.bright@yard.example.org")
    assert p.location == "Lagos | port" and p.skills == ["Welding"]
    assert "location" not in [m.field_name for m in p.missing_fields]
    assert len(p.missing_fields) == 4 and len(p.client_display_rules) == 4


def test_all_sections(spark):
    p = profile(spark, SHIPYARD)
    assert (p.location, p.email, p.phone) == ("Delft", "ilse@harbour.example.net", "+31 20 555 0199")
    assert p.professional_summary == "Keeps cranes running. Second line of it."
    assert p.skills == ["Hydraulics", "Rigging", "PLC"]
    job = p.work_experience[0]
    assert len(p.work_experience) == 1 and job.title == "Crane Technician"
    assert (job.company, job.start_date, job.end_date) == ("Noordkade BV", "Mar 2015", "Jun 2021")
    assert job.description[:2] == ["Cut downtime", "Ran night shifts"]
    assert [d for d in job.description if d.startswith("Project: ")] == ["Project: Quay 4 rebuild"]
    assert [d for d in job.description if d.startswith("Achievement: ")] == [
        "Achievement: Safety award", "Achievement: Patent",
    ]
    school = p.education[0]
    assert (school.degree, school.end_date) == ("MEng Mechatronics", "2014")


def test_special_cases(spark):
    crossing, url, summary, years, blank, empty = profiles(
        spark,
        "A\nSkills:\nPython\nSkills\nGo",
        "A\nhttps://www.linkedin.com/in/a https://github.com/a",
        "A\nSummary\nSkills\nSQL",
        "A\nExperience\nEng at X (2020 - 2024)\nSkills\n• SQL; Go | SQL,",
        "A\nLocation:  \nAddress: Rome\nExperience\nCook\nSkills\nSQL\nEXPERIENCE:\n* Baker",
        None,
    )
    # A value may stand on the next line, and a labelled list wins over the section.
    assert crossing.skills == ["Python"]
    # The first address with a path is the portfolio, even a LinkedIn one.
    assert url.portfolio_url == url.linkedin_url == "https://www.linkedin.com/in/a"
    # An empty summary takes the next line, whatever it is.
    assert summary.professional_summary == "Skills"
    # Without a phone number the years look like one.
    assert years.phone == "2020 - 2024"
    assert years.skills == ["SQL", "Go", "SQL"]
    # The blank location runs into the next line; a repeated heading goes on.
    assert blank.location == "Address: Rome"
    assert [e.title for e in blank.work_experience] == ["Cook"]
    assert blank.work_experience[0].description == ["Baker"]
    assert empty.full_name is None and empty.skills == [] and len(empty.missing_fields) == 5


def test_line_ends_and_unicode(spark):
    p = profile(spark, "　Zoë\x85Location : Köln\r\nzoë@exämple.org\x0bSKILLS:\x1c• SQL Go")
    assert p.full_name == "Zoë"
    assert p.email == "zoë@exämple.org"
    # Only a plain line end starts a labelled line.
    assert p.location is None
    assert p.skills == ["SQL", "Go"]


def test_array_and_window_forms_agree(spark):
    texts = [SHIPYARD, BARE, "x\nSkills\n\nSKILLS::\na\nEducation\nb\nskills\nc", "none", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    blocks = extract.document_sections(docs, "doc_id").select("doc_id", "section", "line")
    lines = extract.document_lines(docs, "doc_id")
    lines.createOrReplaceTempView("lines")
    windowed = spark.sql("""
        SELECT doc_id, section, line FROM (
          SELECT *, last_value(heading, true) OVER (PARTITION BY doc_id ORDER BY line_no) AS section
          FROM lines) WHERE heading IS NULL AND section IS NOT NULL""")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, windowed.collect()))


def test_no_shuffle(spark):
    docs = spark.range(10).selectExpr("id AS doc_id", "'Skills\nSQL' AS text")
    plan = extract.extract_profiles(docs, "doc_id")._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_prompt_round_trip(spark):
    docs = spark.createDataFrame(
        [("a", "Jane\nResume text: odd", "Engineer"), ("b", "Joe", None)],
        "doc_id string, text string, job string",
    )
    rows = (
        extract.prompts(docs, "doc_id", job_description="job")
        .select("doc_id", "prompt", extract.prompt_text(F.col("prompt")).alias("text"))
        .orderBy("doc_id")
        .collect()
    )
    assert rows[0].text == "\nJane\nResume text: odd"
    assert "\nOptional job description:\nEngineer\n" in rows[0].prompt
    assert "Optional job description" not in rows[1].prompt


ODD = st.text(
    alphabet=st.sampled_from(list("aB:1+@. -•\n\r\t\x0b\x1c\x1f\x85 　éß٣(K")), max_size=40
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ODD, min_size=20, max_size=40))
def test_text_functions_follow_python(spark, texts):
    t = F.col("text")
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        .select(
            "i",
            tx.strip(t).alias("strip"),
            tx.solid_lines(tx.with_plain_line_ends(t)).alias("lines"),
            tx.first_line(tx.with_plain_line_ends(t)).alias("first"),
            tx.email(t).alias("email"),
            tx.phone(t).alias("phone"),
            tx.clean_item(t).alias("item"),
        )
        .orderBy("i")
        .collect()
    )

    def found(pattern, text):
        hit = re.search(pattern, text, re.I)
        return hit.group().strip() if hit else None

    for text, row in zip(texts, rows):
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        assert row.strip == text.strip()
        assert row.lines == lines
        assert row["first"] == (lines[0] if lines else None)
        assert row.email == found(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", text)
        assert row.phone == found(r"\+?\d[\d\s().-]{7,}\d", text)
        assert row.item == re.sub(r"^[-•*]\s*", "", text.strip()).strip()


HEADED = st.lists(
    st.sampled_from(
        ["Skills", " SKILLS: ", "skills :", "Work Experience::", "text", "", "\t", "a: b",
         "sKills", "Summary", "　Education　"]
    ),
    max_size=8,
)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(HEADED, st.sampled_from(["\n", "\r\n", "\x0b", "\x85", " ", "\x1d\n"])),
        min_size=20,
        max_size=40,
    )
)
def test_headings_follow_python(spark, docs):
    texts = [end.join(lines) for lines, end in docs]
    lined = tx.with_plain_line_ends(F.col("text"))
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        .select("i", sections.heading_cuts(lined).alias("cuts"), sections.line_after(lined, "summary")
                .alias("below"))
        .orderBy("i")
        .collect()
    )
    for text, row in zip(texts, rows):
        lines = text.splitlines()
        plain = [x.strip().rstrip(":") for x in lines]
        assert row.cuts[1::2] == [x for x in plain if x.lower() in C.SECTION_HEADINGS]
        at = [i for i, x in enumerate(lines) if x.strip().lower() == "summary"]
        below = lines[at[0] + 1].strip() if at and at[0] + 1 < len(lines) else ""
        assert row.below == (below or None)


def test_section_lines_are_trimmed_once(spark):
    """Lines of a section come trimmed; trimming a set of characters costs more than all else of
    a line, so what cleans such lines does not trim, and still trims what stands behind a mark."""
    lines = spark.createDataFrame([(["- one", "*\u3000 two", "-", "three"],)], "lines array<string>")
    cleaned = lines.select(sections.section_text(F.col("lines")).alias("text"))
    assert cleaned.first().text == "one two three"
    plan = cleaned._jdf.queryExecution().analyzed().toString().lower()
    assert "trim" not in plan
