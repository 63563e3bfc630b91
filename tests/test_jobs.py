"""The stored job table against the state of the whole log."""

import random

import pytest

from tests.test_artifacts import COLUMNS, event, table
from vitaloom import schemas as S
from vitaloom.operators import artifacts
from vitaloom.sources.jobs import JobTable
from vitaloom.streaming import state as stream


KINDS = ("processed", "target_format_uploaded", "generated")


def log(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = list(
            event(
                f"a{rng.randrange(12)}", rng.randrange(60), rng.choice(KINDS),
                seq=i, source_filename=rng.choice([None, f"f{i}"]), template_name=f"t{i}",
                missing_field_labels=rng.choice([None, [], ["x", "y"]]),
            )
        )
        row[COLUMNS.index("debug_artifacts")] = rng.choice([None, {}, {"raw": f"r{i}"}, {"raw": f"q{i}", "pdf": f"p{i}"}])
        rows.append(tuple(row))
    return rows


def flat(df):
    return sorted((repr(sorted(r.asDict(True).items())) for r in df.collect()))


def whole(spark, rows):
    events = table(spark, *rows)
    return flat(artifacts.with_debug_artifacts(artifacts.artifact_state(events), events))


@pytest.fixture
def jobs(spark, tmp_path):
    return JobTable(spark, str(tmp_path / "jobs"), buckets=5)


def test_merges_in_any_order_equal_the_whole_log(spark, jobs):
    rows = log(1)
    random.Random(2).shuffle(rows)
    for i in range(0, 200, 70):
        assert jobs.merge(table(spark, *rows[i : i + 70]))
    assert flat(jobs.records()) == whole(spark, rows)
    jobs.merge(table(spark, *rows[30:90]))  # again, without a number
    assert flat(jobs.records()) == whole(spark, rows)


def test_a_replayed_batch_is_passed_over(spark, jobs):
    rows = log(3, 60)
    assert jobs.merge(table(spark, *rows[:30]), "s", 0)
    assert jobs.merge(table(spark, *rows[30:]), "s", 1)
    number = jobs.manifest().number
    assert not jobs.merge(table(spark, *log(4, 10)), "s", 1)
    assert not jobs.merge(table(spark, *log(4, 10)), "s", 0)
    assert jobs.manifest().number == number and flat(jobs.records()) == whole(spark, rows)
    assert jobs.merge(table(spark, *rows[:1]), "other", 0)


def test_an_interrupted_merge_leaves_the_table_as_it_was(spark, jobs, monkeypatch):
    rows = log(5, 80)
    jobs.merge(table(spark, *rows[:40]), "s", 0)
    before = flat(jobs.records())

    def die(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(JobTable, "_commit", die)
        with pytest.raises(RuntimeError):
            jobs.merge(table(spark, *rows[40:]), "s", 1)
    assert flat(jobs.records()) == before
    assert jobs.merge(table(spark, *rows[40:]), "s", 1)
    assert flat(jobs.records()) == whole(spark, rows)


def test_a_broken_manifest_is_passed_over(spark, jobs, tmp_path):
    rows = log(6, 40)
    jobs.merge(table(spark, *rows[:20]))
    (tmp_path / "jobs" / "manifests" / "000000000001.json").write_text('{"number": 1, "fol')
    assert flat(jobs.records()) == whole(spark, rows[:20])
    jobs.merge(table(spark, *rows[20:]))
    assert jobs.manifest().number == 2 and flat(jobs.records()) == whole(spark, rows)


def test_two_writers_lose_nothing(spark, jobs, monkeypatch):
    rows = log(7, 60)
    jobs.merge(table(spark, *rows[:20]))
    other = JobTable(spark, jobs.folder, buckets=5)
    plain, done = JobTable._rewrite, []

    def slow(self, base, new, touched):
        folder = plain(self, base, new, touched)
        if self is jobs and not done:
            done.append(other.merge(table(spark, *rows[20:40])))  # commits in between
        return folder

    monkeypatch.setattr(JobTable, "_rewrite", slow)
    assert jobs.merge(table(spark, *rows[40:]))
    assert done == [True] and flat(jobs.records()) == whole(spark, rows)


def test_only_touched_buckets_are_rewritten_and_one_is_read(spark, jobs):
    rows = log(8)
    jobs.merge(table(spark, *rows))
    first = jobs.manifest().folders
    one = [event("a3", 99, "processed", seq=999, source_filename="new")]
    jobs.merge(table(spark, *one))
    second = jobs.manifest().folders
    changed = [b for b in second if second[b] != first.get(b)]
    assert len(changed) == 1 and len(first) > 1
    found = jobs.lookup("a3")
    assert {f"bucket={changed[0]}" in f for f in found.inputFiles()} == {True}
    assert len({f.rpartition("/")[0] for f in found.inputFiles()}) == 1
    assert found.first().source_filename == "new"
    assert jobs.lookup("a/3").count() == 0 and jobs.lookup("nobody").count() == 0


def test_recent_and_expiry(spark, jobs, tmp_path):
    rows = log(9, 90)
    for i in range(0, 90, 30):
        jobs.merge(table(spark, *rows[i : i + 30]))
    state = artifacts.artifact_state(table(spark, *rows))
    expected = [r.artifact_id for r in artifacts.recent(state, 4).collect()]
    order = jobs.recent(4).orderBy(artifacts.F.col("updated_at").desc(), "artifact_id")
    assert [r.artifact_id for r in order.collect()] == expected
    assert jobs.expire(keep=1) > 0
    assert len(list((tmp_path / "jobs" / "manifests").glob("*.json"))) == 1
    assert flat(jobs.records()) == whole(spark, rows)


def test_hard_rows(spark, jobs):
    assert jobs.records().count() == 0
    assert jobs.merge(spark.createDataFrame([], S.ARTIFACT_EVENT), "s", 0)
    assert jobs.records().count() == 0 and jobs.recent().count() == 0
    nobody = list(event("x", 1, "processed"))
    nobody[0] = None
    jobs.merge(table(spark, tuple(nobody), event("x", 2, "something else"), event("", 3, "processed")))
    assert sorted(r.artifact_id for r in jobs.records().collect()) == ["", "x"]
    assert jobs.lookup("").count() == 0


def test_stream_into_the_table_survives_a_restart(spark, jobs, tmp_path):
    source, rows = str(tmp_path / "log"), log(10, 90)
    checkpoint = str(tmp_path / "checkpoint")
    for i in range(0, 90, 30):
        table(spark, *rows[i : i + 30]).coalesce(1).write.mode("append").parquet(source)
        events = stream.stream_events(spark, source, files_per_batch=1)
        stream.start_job_sink(events, jobs, checkpoint).awaitTermination()
    assert flat(jobs.records()) == whole(spark, rows)
    # The stream forgets its last batch after the table has it: it comes again.
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    number = jobs.manifest().number
    events = stream.stream_events(spark, source, files_per_batch=1)
    stream.start_job_sink(events, jobs, checkpoint).awaitTermination()
    assert jobs.manifest().number == number and flat(jobs.records()) == whole(spark, rows)
