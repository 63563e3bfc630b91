from datetime import datetime, timedelta

import random

import pytest
from pyspark.sql import Row

from vitaloom import schemas as S
from vitaloom.operators import artifacts
from vitaloom.sources import tables
from vitaloom.streaming import state as stream

T0 = datetime(2024, 1, 1)
COLUMNS = [f.name for f in S.ARTIFACT_EVENT.fields]


def event(artifact, minute, kind, seq=0, **values):
    row = dict.fromkeys(COLUMNS)
    row.update(
        artifact_id=artifact, ts=T0 + timedelta(minutes=minute), seq=seq, event_type=kind,
        artifact_dir=f"out/{artifact}/{minute}", debug_artifacts={}, **values,
    )
    return tuple(row[c] for c in COLUMNS)


def table(spark, *events):
    return spark.createDataFrame(list(events), S.ARTIFACT_EVENT)


THREE_WRITERS = (
    event("demo", 0, "processed", source_filename="resume.docx", source_file_type="docx",
          original_preview_error="no tool", missing_field_labels=["Salary expectation"]),
    event("demo", 1, "target_format_uploaded", target_format_role="pdf_reference",
          target_format_filename="sample.pdf"),
    event("demo", 2, "generated", template_name="apex_standard", blind_profile=True,
          missing_field_labels=[]),
)


def test_three_writers_make_one_row(spark):
    (row,) = artifacts.artifact_state(table(spark, *THREE_WRITERS)).collect()
    assert (row.status, row.source_filename, row.target_format_role) == (
        "generated", "resume.docx", "pdf_reference",
    )
    assert row.blind_profile is True and row.needs_review_count == 0
    assert row.missing_field_labels == []
    assert (row.created_at, row.updated_at) == (T0, T0 + timedelta(minutes=2))
    assert row.artifact_dir == "out/demo/2"


def test_supplied_null_overwrites_and_late_events_do_not(spark):
    events = (
        *THREE_WRITERS,
        event("demo", 5, "processed", source_filename="second.pdf", source_file_type="pdf"),
        # Arrives last, happened earlier.
        event("demo", 3, "processed", source_filename="late.pdf", original_preview_error="late"),
    )
    (row,) = artifacts.artifact_state(table(spark, *events)).collect()
    assert row.source_filename == "second.pdf" and row.original_preview_error is None
    assert row.status == "processed" and row.template_name == "apex_standard"


def test_target_upload_alone(spark):
    (row,) = artifacts.artifact_state(table(spark, THREE_WRITERS[1])).collect()
    assert row.needs_review_count is None and row.missing_field_labels == []
    assert row.source_filename is None


def debug_event(minute, debug, artifact="demo", seq=0):
    values = list(event(artifact, minute, "processed", seq))
    values[COLUMNS.index("debug_artifacts")] = debug
    return tuple(values)


def test_debug_maps_merge(spark):
    events = table(
        spark,
        debug_event(2, {"a": "new", "c": "3"}),
        debug_event(0, {"a": "old", "b": "2"}),
        debug_event(2, {"c": "4"}, seq=1),
    )
    (row,) = artifacts.debug_maps(artifacts.debug_entries(events)).collect()
    assert row.debug_artifacts == {"a": "new", "b": "2", "c": "4"}


def test_lookup_and_listing(spark):
    state = artifacts.artifact_state(
        table(spark, *[event(f"a{i}", i % 3, "processed") for i in range(7)])
    )
    assert [r.artifact_id for r in artifacts.recent(state, 3).collect()] == ["a2", "a5", "a1"]
    assert artifacts.recent(state, 0).count() == 1
    assert artifacts.recent(state, 10_000).count() == 7
    assert artifacts.lookup(state, "a3").count() == 1
    assert artifacts.lookup(state, "a/3").count() == 0
    plan = artifacts.recent(state)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_originals_stay(spark, tmp_path):
    folder = str(tmp_path / "out")
    schema = "artifact_id string, text string, profile " + S.PROFILE.simpleString()
    profile = {f.name: None for f in S.PROFILE.fields}
    first = spark.createDataFrame([("a", "one", {**profile, "full_name": "Ann"})], schema)
    again = spark.createDataFrame(
        [("a", "two", {**profile, "full_name": "Eve"}), ("b", "b", profile)], schema
    )
    tables.write_process_outputs(first, folder)
    tables.write_process_outputs(again, folder)
    rows = spark.read.parquet(f"{folder}/profiles").collect()
    assert {r.artifact_id: r.profile.full_name for r in rows} == {"a": "Ann", "b": None}

    generated = again.selectExpr(
        "artifact_id", "1L AS generation", "'late' AS text", "profile",
        "named_struct('candidate_heading', 'x') AS context",
        "CAST(NULL AS " + S.TARGET_FORMAT.simpleString() + ") AS target_format",
    )
    tables.write_generate_outputs(generated, folder)
    tables.write_generate_outputs(generated, folder)
    texts = {r.artifact_id: r.text for r in spark.read.parquet(f"{folder}/raw_text").collect()}
    assert texts == {"a": "one", "b": "b"}
    assert spark.read.parquet(f"{folder}/export_snapshots").count() == 2
    assert spark.read.parquet(f"{folder}/profiles").count() == 2


def test_profiles_json_round_trip(spark, tmp_path):
    folder = str(tmp_path / "json")
    profile = {f.name: None for f in S.PROFILE.fields}
    schema = "doc_id string, profile " + S.PROFILE.simpleString()
    df = spark.createDataFrame([("a", {**profile, "full_name": "Zoë", "skills": ["ü"]})], schema)
    tables.write_profiles_json(df, folder)
    text = spark.read.text(folder).first()[0]
    assert "Zoë" in text and '"email":null' in text
    assert tables.read_profiles_json(spark, folder).collect() == df.collect()


@pytest.mark.parametrize("sink", ["state", "debug"])
def test_stream_equals_batch(spark, tmp_path, sink):
    rng = random.Random(7)
    events = []
    for seq in range(120):
        # One artifact holds about half of the events; times are out of order.
        artifact = "hot" if rng.random() < 0.5 else f"a{rng.randrange(6)}"
        kind = rng.choice(["processed", "target_format_uploaded", "generated"])
        values = list(event(artifact, rng.randrange(50), kind, seq))
        for name, choices in {
            "source_filename": [None, "x", "y"], "template_name": [None, "t", "u"],
            "target_format_role": ["r", "s"], "missing_field_labels": [["L"], [], None],
        }.items():
            values[COLUMNS.index(name)] = rng.choice(choices)
        values[COLUMNS.index("debug_artifacts")] = {rng.choice("abc"): str(seq)}
        events.append(tuple(values))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    start, batch, key = {
        "state": (stream.start_state_sink, artifacts.artifact_state, ["artifact_id"]),
        "debug": (stream.start_debug_sink, artifacts.debug_entries, ["artifact_id", "name"]),
    }[sink]
    for i in range(0, len(events), 40):
        table(spark, *events[i:i + 40]).coalesce(1).write.mode("append").parquet(source)
        query = start(stream.stream_events(spark, source, 1), out, str(tmp_path / "check"))
        query.awaitTermination()
        assert query.exception() is None

    def rows(df):
        return sorted(map(repr, (Row(**r.asDict()) for r in df.collect())))

    expected = batch(table(spark, *events))
    live = stream.current(spark, out, *key).select(*expected.columns)
    assert rows(live) == rows(expected)
    compacted = str(tmp_path / "compact")
    stream.compact(spark, out, compacted, *key)
    assert rows(stream.current(spark, compacted, *key).select(*expected.columns)) == rows(expected)
