"""The chain from a request to its export."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.operators import blueprints, edits as ed, extract, generate
from vitaloom.plans.queries import QUERIES
from vitaloom.sources.bucketed import write_bucketed
from vitaloom.templates import built_in_registry

SF = "/root/testdata/sf0.001"
RESUME = "Mira Okafor\nmira@example.org\nSkills\nSQL, Rust\nExperience\nClerk at Depot (2019 to 2021)\n- Filed papers\n"
REQUESTS = (
    "request_id string, artifact_id string, requested map<string,string>, blind boolean,"
    f" template_name string, target_format {S.TARGET_FORMAT.simpleString()}"
)


def profiles(spark, *ids):
    docs = spark.createDataFrame([(i, RESUME.replace("Mira", f"Mira {i}")) for i in ids], "id string, text string")
    return extract.extract_profiles(docs, "id").select(F.col("id").alias("artifact_id"), "profile")


def formats(spark, *ids):
    """Uploads without a match, as they are stored."""
    uploads = spark.createDataFrame([(i, f"{i}.docx", "docx", None, None) for i in ids],
        "artifact_id string, input_filename string, source_reference_type string,"
        " matched_template_id string, blueprint_version int")  # fmt: skip
    return blueprints.target_format(uploads)


def stored(records):
    name = F.col("target_format.stored_filename")
    return records.select(
        "artifact_id", F.array(name).alias("stored_files"), F.to_json("target_format").alias("metadata_json")
    )


def edits(spark, *rows):
    return spark.createDataFrame(list(rows), S.EDIT)


def run(spark, requests, ids=("a", "b"), uploads=("b",), log=(), buckets=None):
    asked = spark.createDataFrame(requests, REQUESTS) if isinstance(requests, list) else requests
    made = generate.exports(
        asked, profiles(spark, *ids), edits(spark, *log), stored(formats(spark, *uploads)),
        built_in_registry(spark), buckets,
    )
    return {r.request_id: r for r in made.collect()}


def test_lines_or_a_reason_for_each_request(spark):
    record = formats(spark, "b").first().target_format
    other = record.asDict() | {"note": "changed"}
    got = run(
        spark,
        [
            ("plain", "a", None, False, None, None),
            ("blind", "a", {"email": "hide"}, True, C.DEFAULT_TEMPLATE, None),
            ("unknown", "a", None, None, "none such", None),
            ("nobody", "z", None, False, "none such", None),
            ("uploaded", None, None, False, None, record.asDict()),
            ("changed", "b", None, False, None, other),
            ("of another", "a", None, False, "none such", record.asDict()),
        ],
    )
    assert len(got) == 7
    reasons = {k: r.reason for k, r in got.items()}
    assert reasons == {
        "plain": None,
        "blind": None,
        "unknown": "Unknown target format blueprint: none such",
        "nobody": generate.NO_PROFILE,
        "uploaded": None,
        "changed": C.REF_METADATA_DIFFERS,
        "of another": C.REF_ID_MISMATCH,
    }
    assert all((r.lines is None) == (r.reason is not None) for r in got.values())
    assert got["uploaded"].artifact_id == "b"
    text = {k: [x.text for x in r.lines or []] for k, r in got.items()}
    assert "Mira a Okafor" in text["plain"] and "Mira b Okafor" in text["uploaded"]
    assert "Mira a Okafor" not in text["blind"] and not any("mira@" in t for t in text["blind"])


def test_edits_come_before_rules_and_missing_fields(spark):
    log = [
        ("a", "location", "Lagos", 1),
        ("a", "notice_period", "  ", 2),
        ("a", "skills.2", "Go", 3),
        ("a", "education.0.degree", "nowhere", 4),
        ("b", "email", "new@example.org", 5),
    ]
    got = run(
        spark,
        [("one", "a", {"notice_period": "hide"}, False, None, None), ("two", "b", None, False, None, None)],
        log=log,
    )
    one, two = got["one"], got["two"]
    assert "location" not in one.open_fields and "notice_period" in one.open_fields
    assert set(two.open_fields) == set(C.REQUIRED_FIELDS)
    assert one.profile.location == "Lagos" and one.profile.skills == ["SQL", "Rust", "Go"]
    assert one.profile.client_display_rules["notice_period"] == "hide"
    assert "location" not in one.profile.client_display_rules
    assert two.profile.client_display_rules["location"] == C.PENDING_CONFIRMATION
    assert any("new@example.org" in x.text for x in two.lines)


def test_several_requests_of_one_artifact_and_none(spark):
    rows = [(str(i), "a", None, bool(i % 2), None, None) for i in range(50)]
    got = run(spark, rows)
    assert len(got) == 50 and len({tuple(r.lines) for r in got.values()}) == 2
    assert run(spark, spark.createDataFrame([], REQUESTS)) == {}


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stored_sides_are_not_exchanged(unbroadcast, tmp_path):
    spark, sides, buckets = unbroadcast, {}, 3
    ids = [f"x{i}" for i in range(12)]
    for name, df in {"profiles": profiles(spark, *ids), "formats": stored(formats(spark, *ids))}.items():
        table = f"{name}_{uuid.uuid4().hex}"
        sides[name] = write_bucketed(df, table, str(tmp_path / name), "artifact_id", buckets)
    asked = spark.createDataFrame([(i, i, None, False, None, None) for i in ids], REQUESTS)
    log = edits(spark, *[(i, "location", f"in {i}", 1) for i in ids])
    made = generate.exports(
        asked, sides["profiles"], log, sides["formats"], built_in_registry(spark), buckets
    )
    got = made.collect()
    assert len(got) == 12 and all(r.profile.location == f"in {r.artifact_id}" for r in got)
    plan = made._jdf.queryExecution().executedPlan().toString()

    def above(line_no):
        """Operators between a scan and the join it feeds."""
        lines = plan.split("\n")
        depth, out = len(lines[line_no]) - len(lines[line_no].lstrip(" :+-*")), []
        for line in reversed(lines[:line_no]):
            here = len(line) - len(line.lstrip(" :+-*"))
            if here < depth:
                depth = here
                out.append(line)
                if "Join" in line:
                    break
        return "\n".join(out)

    scans = [i for i, line in enumerate(plan.split("\n")) if "FileScan parquet" in line and "Bucketed: true" in line]
    joined = [above(i) for i in scans]
    assert len(scans) >= 3  # profiles twice (their lists, themselves) and formats
    # Only the narrow side of list shapes may meet the edits before they are collected.
    assert sum("Exchange" not in x for x in joined) >= 2
    whole = [above(i) for i in scans if "metadata_json" in plan.split("\n")[i] or "full_name" in plan.split("\n")[i]]
    assert whole and all("Exchange" not in x for x in whole)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_exports_compute_and_send_nothing_twice(spark):
    made = QUERIES["generate_exports"](spark, SF)
    lines = made._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [line for line in lines if "FileScan parquet" in line]
    stored = [line for line in scans if "default.profiles_" in line]
    assert len(stored) == 2  # the lists that edits name, and the profiles themselves
    assert not any("html" in line for line in scans)  # blueprints are checked once, before

    def below(line_no):
        depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
        for line in lines[line_no + 1 :]:
            if depth(line) <= depth(lines[line_no]):
                return
            yield line

    sent = [x for i, line in enumerate(lines) if "BroadcastExchange" in line for x in below(i)]
    assert not any("default.profiles_" in x or "o_orderkey" in x for x in sent)


def test_the_log_is_dealt_once_to_stored_profiles(unbroadcast, tmp_path):
    spark, buckets = unbroadcast, 3
    ids = [f"x{i}" for i in range(12)]
    table = f"profiles_{uuid.uuid4().hex}"
    held = write_bucketed(profiles(spark, *ids), table, str(tmp_path / "profiles"), "artifact_id", buckets)
    rows = [(i, "location", v, s) for i in ids for s, v in enumerate(("Rome", "", f"in {i}"))]
    edits(spark, *rows, ("x0", "skills", "Go, C", 7)).write.parquet(str(tmp_path / "log"))
    made = ed.apply_edits(held, spark.read.parquet(str(tmp_path / "log")), buckets)
    got = {r.artifact_id: r.profile for r in made.collect()}
    assert {i: p.location for i, p in got.items()} == {i: f"in {i}" for i in ids}
    assert got["x0"].skills == ["Go", "C"] and got["x1"].skills == ["SQL", "Rust"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(artifact_id#" in plan
    # By path, too, meet only those that were cleared and the log.
    assert len(re.findall(r"Exchange hashpartitioning\(artifact_id#\d+, path#", plan)) == 2
