import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.operators import completions, extract
from vitaloom.session import checkpoint_for
from vitaloom.sources import files, tables
from vitaloom.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(*texts):
    return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def tc(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"


def tr(*cells):
    return "<w:tr>" + "".join(cells) + "</w:tr>"


def write_docx(path, body, content_types=True):
    with zipfile.ZipFile(path, "w") as package:
        if content_types:
            package.writestr("[Content_Types].xml", "<Types/>")
        package.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        package.writestr("word/media/image1.png", b"\x89PNG")


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    table = "<w:tbl>" + tr(tc("Company"), tc("Role")) + tr(tc(" "), tc("")) + tr(
        tc("Acme"), tc("Engineer")) + "</w:tbl>"
    write_docx(
        tmp_path / "a.docx",
        p(" Jane ", "Candidate ") + table + p("  ") + p("Skills: Python, SQL")
        + '<w:p><w:r><w:drawing/></w:r><w:hyperlink><w:r><w:t>link</w:t><w:tab/></w:r></w:hyperlink>'
          "<w:r><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p>",
    )
    merged = "<w:tbl>" + tr(tc("wide", '<w:gridSpan w:val="2"/>'), tc("z")) + tr(
        tc("top", '<w:vMerge w:val="restart"/>'), tc("b"), tc("c")) + tr(
        tc("", "<w:vMerge/>"), tc("d"), tc("")) + "</w:tbl>"
    write_docx(tmp_path / "sub" / "B.DOCX", merged)
    write_docx(tmp_path / "no_types.docx", p("x"), content_types=False)
    write_docx(tmp_path / "broken_xml.docx", "<w:p>")
    (tmp_path / "bad.docx").write_text("not a zip")
    (tmp_path / "c.pdf").write_text("%PDF")
    (tmp_path / "~$a.docx").write_text("lock")
    (tmp_path / "notes.txt").write_text("first\nsecond")
    return tmp_path


def test_scan_and_read(spark, folder):
    found = files.scan_files(spark, str(folder))
    names = [r.path.rsplit("/", 1)[1] for r in found.orderBy("path").select("path").collect()]
    assert names == ["a.docx", "bad.docx", "broken_xml.docx", "c.pdf", "no_types.docx", "B.DOCX"]
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.docx_text(found).collect()}
    assert rows["a.docx"].text == (
        "Jane Candidate\nSkills: Python, SQL\nlink\tx\ny\nCompany | Role\nAcme | Engineer"
    )
    assert rows["B.DOCX"].text == "wide | wide | z\ntop | b | c\ntop | d"
    assert (rows["bad.docx"].error_type, rows["bad.docx"].error) == (files.CORRUPTED, C.DOCX_CORRUPT)
    assert rows["no_types.docx"].error == C.DOCX_NO_CONTENT_TYPES
    assert rows["c.pdf"].error_type == files.UNSUPPORTED and rows["c.pdf"].text is None
    assert rows["broken_xml.docx"].error_type == "ParseError"


def test_scan_text(spark, folder):
    rows = files.scan_text(spark, str(folder / "notes.txt")).collect()
    assert [r.text for r in rows] == ["first\nsecond"]


def test_streamed_extraction_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a", "Ann\nSkills: SQL"), ("b", " "), ("c", "Bob\nEducation\nBSc – X (2001)")],
        "doc_id string, text string",
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(source)
    texts = ingest.stream_texts(spark, source, "doc_id string, text string", 1)
    ingest.start_profile_sink(texts, out, "doc_id", checkpoint=str(tmp_path / "c")).awaitTermination()
    batch = ingest.profiles_of(docs, "doc_id").orderBy("doc_id").collect()
    live = spark.read.parquet(out).orderBy("doc_id").collect()
    assert [r.asDict(True) for r in live] == [r.asDict(True) for r in batch]
    assert [r.reason is None for r in batch] == [True, False, True]


def test_streamed_files(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    texts = ingest.stream_docx(spark, str(folder), 2)
    query = ingest.start_profile_sink(
        texts.where(F.col("error").isNull()), str(out / "t"), "path", checkpoint=str(out / "c")
    )
    query.awaitTermination()
    names = {r.profile.full_name for r in spark.read.parquet(str(out / "t")).collect()}
    assert names == {"Jane Candidate", "wide | wide | z"}


class Fake:
    """Answers from the prompt itself; fails on request."""

    def complete_json(self, system, prompt):
        text = prompt.split(C.PROMPT_TEXT_MARK, 1)[1].strip()
        if text == "fail":
            raise RuntimeError("no answer")
        if text == "prose":
            return "I cannot help"
        return "Here: " + json.dumps({"full_name": text, "skills": ["SQL"]})


class Never:
    def complete_json(self, system, prompt):
        raise AssertionError("asked again: " + prompt[-10:])


def test_completion_client(spark, tmp_path):
    folder = str(tmp_path / "answers")
    docs = spark.createDataFrame(
        [("a", "Ann"), ("b", "fail"), ("c", "prose")], "doc_id string, text string"
    )
    rows = {r.doc_id: r for r in completions.extract_with_client(docs, Fake, folder).collect()}
    assert rows["a"].profile.full_name == "Ann" and len(rows["a"].profile.missing_fields) == 5
    assert rows["b"].reason == "RuntimeError: no answer"
    assert rows["c"].reason == "response did not contain JSON"
    # Answers are kept; only the failed call is made again.
    again = {r.doc_id: r for r in completions.extract_with_client(docs, Never, folder).collect()}
    assert again["a"].profile.full_name == "Ann" and again["b"].profile is None
    fixed = docs.replace("fail", "Bob", "text")
    last = {r.doc_id: r for r in completions.extract_with_client(fixed, Fake, folder).collect()}
    assert last["b"].profile.full_name == "Bob" and last["b"].reason is None
    # A changed text or model is a new prompt; the newest answer of a prompt counts.
    changed = docs.replace("Ann", "Zoe", "text")
    new = {r.doc_id: r for r in completions.extract_with_client(changed, Fake, folder).collect()}
    assert new["a"].profile.full_name == "Zoe"
    back = {r.doc_id: r for r in completions.extract_with_client(docs, Fake, folder).collect()}
    assert back["a"].profile.full_name == "Ann"
    other = completions.extract_with_client(docs, Never, folder, model="m").collect()
    assert {r.reason is None for r in other} == {False}


def test_providers():
    seen = []
    providers = {"house": lambda settings: seen.append(settings) or Fake}
    assert completions.client_factory(providers, "House", {"model": "m"}) is Fake
    assert seen == [{"model": "m"}]
    with pytest.raises(ValueError, match="Unsupported provider: other"):
        completions.client_factory(providers, "other")


def test_native_extraction_from_a_prompt(spark):
    docs = spark.createDataFrame([("a", "Ann\nSkills: SQL")], "doc_id string, text string")
    asked = extract.prompts(docs, "doc_id")
    texts = asked.select("doc_id", extract.prompt_text(F.col("prompt")).alias("text"))
    assert extract.extract_profiles(texts, "doc_id").first().profile.skills == ["SQL"]


def test_checkpoints_stand_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, other = (checkpoint_for(spark, "p", f"s3://bucket/{i}") for i in "ab")
    assert one != other and one.startswith(f"{shared}/p-")
    assert one == checkpoint_for(spark, "p", "s3://bucket/a")


def test_other_files_are_not_listed_and_pdfs_not_read(spark, tmp_path):
    for name in ("a.txt", "b.PDF", "c.DocX", "~$d.docx", "e.docx.bak"):
        (tmp_path / name).write_bytes(b"no package")
    found = files.scan_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"b.PDF", "c.DocX"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.inputFiles() and not [f for f in found.inputFiles() if f.endswith((".txt", ".bak"))], plan
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.docx_text(found).collect()}
    assert (rows["b.PDF"].text, rows["b.PDF"].error_type) == (None, files.UNSUPPORTED)
    assert rows["c.DocX"].error_type == files.CORRUPTED


def test_a_huge_inflated_document_is_a_reason(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.docx", "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", "<x/>")
        package.writestr("word/document.xml", " " * (files.MAX_DOCUMENT_BYTES + 1))
    row = files.docx_text(files.scan_files(spark, str(tmp_path))).collect()[0]
    assert (row.text, row.error_type) == (None, files.TOO_LARGE)


def test_one_row_of_a_key_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "artifact_id string, n int")
    tables.append_new(rows, str(tmp_path / "t"), "artifact_id")
    tables.append_new(rows, str(tmp_path / "t"), "artifact_id")
    assert sorted(r.artifact_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
