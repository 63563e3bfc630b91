import re

from vitaloom.llm import preferences as P

S, E = "<|im_start|>", "<|im_end|>\n"


def table(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string, prompt string")


def test_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (1, "chosen", 0, "user", "hi"),
        (2, "chosen", 0, "user", "only"),
        (3, "rejected", 5, "user", "only"),
        (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a"), (4, "chosen", 1, "assistant", None),
        (5, "chosen", None, None, None), (5, "rejected", None, None, None),
        (6, "chosen", 0, None, "x"), (6, "rejected", 0, "", "x"),
        (7, "chosen", 0, "user", "é\U0001f600"), (7, "rejected", 0, "user", "e"),
        (7, "chosen", 1, "assistant", "ok"), (7, "chosen", 2, "user", "u"), (7, "chosen", 3, "assistant", ""),
        (8, "chosen", 0, "user", "tie"), (8, "chosen", 0, "assistant", "tie"), (8, "rejected", 0, "assistant", "tie"),
        (None, "chosen", 0, "user", "x"), (9, "other", 0, "user", "x"), (9, None, 0, "user", "x"),
    ]
    got = {r.pair_id: r for r in P.format_pairs(table(spark, [(*r, "clash") for r in rows])).collect()}
    assert set(got) == set(range(1, 9))
    one = got[1]
    assert (one.n_prefix, one.prompt) == (1, f"{S}user\nhi{E}")
    assert (one.chosen, one.rejected) == (f"{S}assistant\ngood{E}", f"{S}assistant\nbad{E}")
    for side, spans, want in ((one.chosen, one.chosen_spans, "good"), (one.rejected, one.rejected_spans, "bad")):
        assert [side[s.start : s.start + s.length] for s in spans] == [want]
    assert (got[2].prompt, got[2].rejected, got[2].rejected_spans) == ("", None, None)
    assert got[3].chosen is None and got[3].rejected_spans == []
    assert (got[4].rejected, [tuple(s) for s in got[4].chosen_spans]) == ("", [(len(S) + 10, 0)])
    assert (got[5].n_prefix, got[5].prompt, got[5].chosen) == (1, f"{S}\n{E}", "")
    assert got[6].n_prefix == 0
    seven = got[7]
    assert [seven.chosen[s.start : s.start + s.length] for s in seven.chosen_spans] == ["ok", ""]
    assert got[8].n_prefix == 1 and got[8].chosen == f"{S}user\ntie{E}"


def test_long_conversation(spark):
    rows = []
    for side, last in (("chosen", "yes"), ("rejected", "no")):
        rows += [(1, side, t, "assistant" if t % 2 else "user", f"turn {t}", "") for t in range(3001)]
        rows.append((1, side, 3001, "assistant", last, ""))
    got = P.format_pairs(table(spark, rows)).collect()[0]
    assert got.n_prefix == 3001 and got.prompt.count(S) == 3001
    assert got.chosen == f"{S}assistant\nyes{E}"


def test_empty_table_and_plan(spark):
    df = P.format_pairs(table(spark, []))
    assert df.count() == 0
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_of_answers(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "user", "p"), (2, 1, "assistant", "a2"),
        (2, 2, "user", "thanks"), (3, 0, "user", "no answer"), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r for r in P.format_pairs(P.pairs_of_answers(df)).collect()}
    assert got[1].rejected == f"{S}assistant\na2{E}" and got[1].prompt == f"{S}user\nq{E}"
    assert got[2].rejected is None and got[3].rejected is None
