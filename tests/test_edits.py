import random

from vitaloom import schemas as S
from vitaloom.operators import edits, review

BASE = {
    "full_name": "Jane",
    "location": None,
    "skills": ["SQL", "Go", "R"],
    "languages": [{"name": "English", "proficiency": None}],
    "work_experience": [
        {"company": "A", "title": "Cook", "description": ["x", "y"]},
        {"company": "B", "title": "Chef", "description": []},
    ],
    "education": [{"institution": "U", "degree": "BSc"}],
    "certifications": [{"name": "CPA"}],
    "missing_fields": [],
    "client_display_rules": {"skills": "pending_confirmation", "email": "hide"},
}


def tables(spark, *log, profiles=None):
    base = {f.name: BASE.get(f.name) for f in S.PROFILE.fields}
    schema = "artifact_id string, profile " + S.PROFILE.simpleString()
    stored = spark.createDataFrame(profiles or [("a", base), ("untouched", base)], schema)
    rows = [("a", path, value, i) for i, (path, value) in enumerate(log)]
    return review.with_missing(stored), spark.createDataFrame(rows, S.EDIT)


def edited(spark, *log):
    profiles, changes = tables(spark, *log)
    return {r.artifact_id: r.profile for r in edits.apply_edits(profiles, changes).collect()}


def test_edits_reach_nested_places(spark):
    both = edited(
        spark,
        ("location", "Rome"),
        ("work_experience.1.title", "Head Chef"),
        ("work_experience.0.description.1", "why"),
        ("languages.0.proficiency", "Fluent"),
        ("education.0.end_date", "2010"),
        ("certifications.0.issuer", "Board"),
        ("skills.1", "Rust"),
    )
    p, other = both["a"], both["untouched"]
    assert p.location == "Rome" and "location" not in p.client_display_rules
    assert [e.title for e in p.work_experience] == ["Cook", "Head Chef"]
    assert p.work_experience[0].description == ["x", "why"]
    assert p.languages[0].proficiency == "Fluent" and p.education[0].end_date == "2010"
    assert p.certifications[0].issuer == "Board" and p.skills == ["SQL", "Rust", "R"]
    assert p.client_display_rules["email"] == "hide"
    assert p.client_display_rules["notice_period"] == "pending_confirmation"
    assert "skills" not in p.client_display_rules
    # The missing fields are those of the stored profile; others stay as they are.
    assert "location" in [m.field_name for m in p.missing_fields]
    assert other.client_display_rules["location"] == "pending_confirmation"
    assert other.skills == BASE["skills"]


def test_skills_text_and_order_of_entry(spark):
    assert edited(spark, ("skills", " a,, b\nc "))["a"].skills == ["a", "b", "c"]
    assert edited(spark, ("skills.1", "X"), ("skills", "a,b"))["a"].skills == ["a", "b"]
    assert edited(spark, ("skills", "a,b"), ("skills.1", "X"))["a"].skills == ["a", "X"]
    # A path keeps its place when edited again, and gets a new one after being cleared.
    again = [("skills", "a,b"), ("skills.1", "X"), ("skills", "c,d")]
    assert edited(spark, *again)["a"].skills == ["c", "X"]
    cleared = [("skills", "a,b"), ("skills.1", "X"), ("skills", ""), ("skills", "c,d")]
    assert edited(spark, *cleared)["a"].skills == ["c", "d"]


def test_current_title(spark):
    log = [("current_title", "One"), ("work_experience.0.title", "Two")]
    assert edited(spark, *log)["a"].work_experience[0].title == "Two"
    assert edited(spark, *reversed(log))["a"].work_experience[0].title == "One"


def test_paths_without_a_place(spark):
    log = [
        ("languages.1.name", "x"), ("skills.4", "x"), ("nonsense", "x"),
        ("work_experience.1.description.1", "x"), ("work_experience.x.title", "x"),
        ("languages.0.level", "x"), ("email", ""), ("phone", "1"),
    ]
    profiles, changes = tables(spark, *log)
    left = {r.path for r in edits.unapplied_edits(profiles, changes).collect()}
    assert left == {path for path, _ in log[:6]}
    p = edited(spark, *log)["a"]
    assert p.phone == "1" and p.email is None and p.skills == BASE["skills"]


def test_open_fields(spark):
    profiles, changes = tables(
        spark, ("location", "Rome"), ("notice_period", " "), ("salary_expectation", "1"),
        ("salary_expectation", ""),
    )
    open_ = edits.remaining_missing(profiles, changes).where("artifact_id = 'a'").collect()
    assert {r.field_name for r in open_} == {
        "salary_expectation", "notice_period", "work_authorization", "interview_availability",
    }
    gate = {r.artifact_id: r.remaining for r in edits.export_gate(profiles, changes).collect()}
    assert gate == {"a": 4, "untouched": 5}


def test_buffer_against_brute_force(spark):
    rng = random.Random(3)
    log = []
    for seq in rng.sample(range(10_000), 600):
        # A third of the log edits one path of one artifact.
        artifact, path = ("hot", "p") if rng.random() < 0.33 else (
            f"a{rng.randrange(5)}", rng.choice("pqr"))
        log.append((artifact, path, rng.choice(["", "x", "y", " "]), seq))
    buffer = {}
    for artifact, path, value, seq in sorted(log, key=lambda e: e[3]):
        if value == "":
            buffer.pop((artifact, path), None)
        else:
            position = buffer.get((artifact, path), (None, seq))[1]
            buffer[artifact, path] = (value, position)
    rows = edits.buffered_edits(spark.createDataFrame(log, S.EDIT)).collect()
    assert {(r.artifact_id, r.path): (r.value, r.position) for r in rows} == buffer


def test_lists_grow_at_their_end(spark):
    assert edited(spark, ("skills.3", "X"), ("skills.4", "Y"))["a"].skills == ["SQL", "Go", "R", "X", "Y"]
    assert edited(spark, ("skills", "x"), ("skills.1", "Y"))["a"].skills == ["x", "Y"]
    five = [("skills", "a,b,c,d,e"), ("skills.4", "Y")]
    assert edited(spark, *five)["a"].skills == ["a", "b", "c", "d", "Y"]
    work = edited(
        spark, ("work_experience.1.description.0", "first"), ("work_experience.0.description.2", "z")
    )["a"].work_experience
    assert [w.description for w in work] == [["x", "y", "z"], ["first"]]


def test_applied_and_unapplied_are_all_buffered(spark):
    """Each buffered edit is either reported or found in the edited profile."""
    log = [
        ("skills", "x"), ("skills.1", "v1"), ("skills.3", "v2"), ("skills.01", "v3"), ("skills.0\n", "v4"),
        ("skills.99999999999999999999999", "v5"), ("languages.00.name", "v6"), ("languages.0.name\n", "v7"),
        ("languages.0.name", "v8"), ("work_experience.0.description.2", "v9"),
        ("work_experience.0.description.4", "v10"), ("work_experience.2.description.0", "v11"),
        ("education.1.degree", "v12"), ("email", "v13"), ("skills.-1", "v14"), ("skills.2", "v15"), ("", "v16"),
    ]
    profiles, changes = tables(spark, *log)
    buffered = {(r.path, r.value) for r in edits.buffered_edits(changes).collect()}
    left = {(r.path, r.value) for r in edits.unapplied_edits(profiles, changes).collect()}
    profile = {r.artifact_id: r.profile for r in edits.apply_edits(profiles, changes).collect()}["a"]
    assert buffered == set(log) and left <= buffered
    text = repr(profile)
    for path, value in log:
        quoted = f"'{value}'"
        assert (quoted in text) != ((path, value) in left), path
    assert {v for _, v in left} == {"v2", "v3", "v4", "v5", "v6", "v7", "v10", "v11", "v12", "v14", "v16"}
