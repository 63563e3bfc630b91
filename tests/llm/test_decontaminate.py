import hashlib
import re

import pytest

from tests.llm.helpers import empty, frame, with_clashes, words
from vitaloom.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs: list, items: list) -> list:
    windows: dict = {}
    for item_id, text in items:
        ws = WORD.findall((text or "").encode().lower())
        if ws and item_id is not None:
            for s in range(max(1, len(ws) - 9)):
                windows.setdefault(tuple(ws[s : s + 10]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        ws = WORD.findall((text or "").encode().lower())
        hit, found = set(), set()
        for w, owners in windows.items():
            for s in range(len(ws) - len(w) + 1):
                if tuple(ws[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    found |= owners
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    item = words(1, 30)
    items = [(1, item), (2, "short one"), (3, None), (4, "..."), (10, item), (5, "the the the the the the the the the the the"), (None, "no id here")]
    w = item.split()
    docs = [
        (1, f"start {item} end"), (2, " ".join(w[:9])), (3, " ".join(w[5:15]).upper() + "!"),
        (4, "a SHORT, one b short two one"), (5, None), (6, ""), (7, "the " * 40), (8, words(9, 3000) + " " + item),
        (8, "short one"), (None, item), (9, f"{item} {item}"), (11, "no id here"), (12, "Éshort one"),
        (13, " ".join([*w[:5], "gap", *w[5:15]])),
    ]
    return docs, items


def test_equals_brute_force(spark, tables):
    docs, items = tables
    df = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    bench = with_clashes(spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted((tuple(r) for r in D.contamination(df, bench).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contamination(empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = D.contamination(frame(spark, {1: "a b"}), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


def test_proximity(spark):
    w = words(1, 10).split()
    near = " ".join([*w[:4], "gap", *w[4:]])
    far = " ".join([*w[:4], "a", "b", "c", "d", *w[4:]])
    df = frame(spark, {1: " ".join(w), 2: near, 3: far})
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    distinct, _ = D.windows(bench)
    terms = D.vocabulary(distinct)
    index = D.build_index(df, terms)
    ranked = D.ranked_terms(distinct, terms, index)
    ids = {r.row_id: r.doc_id for r in index.where("term_id = 0").collect()}
    assert {ids[r.row_id] for r in D.matches(index, ranked).collect()} == {1}
    assert {ids[r.row_id] for r in D.matches(index, ranked, slack=1).collect()} == {1, 2}


def test_no_python_in_the_plan(spark, tables):
    docs, items = tables
    df = D.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
