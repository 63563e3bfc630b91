"""The pipeline against planted cases and its stages' own definitions."""

import hashlib

import pytest

import corpus_pipeline
from tests.llm.helpers import SCHEMA, words
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_minhash import brute as brute_components
from vitaloom.llm.common import stored


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """A folder of tables: clean texts, junk, copies, a shared passage, a benchmark item."""
    folder = tmp_path_factory.mktemp("tables")
    passage, item = words(900, 70), words(901, 25)
    texts = {i: words(i, 60 + i % 90) + "." for i in range(150)}
    junk = {i: " | ".join(words(i, 60).upper().split()) + "!!" for i in range(200, 260)}
    near = texts[5].split()
    near[20] = "changed"
    planted = {
        300: texts[3], 301: texts[3], 302: " ".join(near),
        310: f"{words(310, 80)} {passage} {words(311, 80)}", 311: f"{words(312, 90)} {passage} {words(313, 60)}",
        320: f"{words(320, 50)} {item} {words(321, 50)}",
    }
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in (texts | junk | planted).items()]
    rows += [(None, words(999, 80), None, None, None), (400, None, "en", None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in texts] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(folder)), "stage")
        kept.append(docs)
    return str(folder), texts, junk, passage, item, kept


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE",
    ]


def test_columns_stay(case):
    *_, kept = case
    for df in kept[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_junk_goes_and_clean_stays(case):
    _, texts, junk, *_, kept = case
    assert not ids(kept[0]) & set(junk) and set(texts) <= ids(kept[0])
    assert None in ids(kept[0])


def test_one_of_each_group_stays(case):
    *_, kept = case
    before = {r.doc_id: r.text for r in kept[0].where("doc_id IS NOT NULL").collect()}
    want = {i for i, (_, _, k) in brute_components(before).items() if k}
    assert ids(kept[1]) == want | {None}
    assert {3, 5} <= want and not want & {300, 301, 302}


def test_later_passages_go(case):
    *_, passage, _, kept = case
    after = {r.doc_id: r for r in kept[2].collect()}
    assert passage in after[310].text and passage not in after[311].text
    assert after[311].text.split() == (words(312, 90) + " " + words(313, 60)).split()
    assert after[311].n_chars == len(after[311].text)
    before = {r.doc_id: r.text for r in kept[1].collect()}
    assert {i for i in before if before[i] != after[i].text} == {311}


def test_benchmark_goes(case):
    *_, item, kept = case
    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    want = {r[0] for r in brute_hits(rows, [(1, item)]) if not r[5]}
    assert ids(kept[3]) == want and 320 not in want


def test_tokens_decode_to_the_text(case):
    *_, kept = case
    texts = {r.doc_id: r.text or "" for r in kept[3].collect()}
    got = {r.doc_id: r for r in kept[4].collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert len(got[i].ids) == got[i].n_tokens


def test_run_gives_the_last_stage(spark, case):
    folder, *_, kept = case
    rows = lambda df: sorted((r.doc_id or -1, r.ids_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, folder)) == rows(kept[4])


def test_rows_without_an_id_and_with_a_repeated_one(spark, case):
    """Decisions are made for rows, not for ids."""
    folder, *_, item, _ = case
    clean, other, hit = words(950, 90), words(951, 90), f"{words(952, 40)} {item} {words(953, 40)}"
    rows = [(None, hit), (None, clean), (1, hit), (1, other), (1, other), (2, other + " more"), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = lambda stage: sorted((r.doc_id or -1, r.text or "") for r in stage(spark, docs, folder).collect())
    assert left(corpus_pipeline.uncontaminated) == sorted(
        [(-1, clean), (1, other), (1, other), (2, other + " more"), (3, ""), (3, "")]
    )
    assert left(corpus_pipeline.distinct_documents) == sorted(
        [(-1, hit), (-1, clean), (1, hit), (1, other), (3, ""), (3, "")]
    )
    cut = left(corpus_pipeline.distinct_passages)
    assert (1, hit) in cut or (1, other) in cut
    assert sum(other in t for _, t in cut) in (1, 2) and (-1, hit) in cut
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
