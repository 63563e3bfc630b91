import collections
import math
import re

import numpy as np
import pytest

from tests.llm.helpers import empty, with_clashes, words
from vitaloom.llm import rules


def brute(text):
    data = text or ""
    ws = [w.decode() for w in data.encode().split()]
    lines = [x for x in data.split("\n") if x.encode().split()]
    windows = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    repeated = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    n = len(ws)
    symbols = sum(c in "#*$%&|<>" for c in data)
    return n, sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c", "a b c a b c", "x x x x x", "é\U0001f600 ü\n\nz", "# * $ % & | < >",
    "a\na\n\n\n b\n b\nb", words(1, 60), words(2, 5000), "word " * 3000, "l1 x\nl2 y\nl1 x\n" * 40, " nbsp stays in word",
    "a b c d " * 5 + words(3, 100),
]


def test_statistics_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "one two")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = rules.statistics(df).withColumn("base_failed", rules.base_failed()).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in got:
        assert tuple(r[c] for c in names) == brute(r.text), r.text


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(420):
        n = int(np.exp(rng.normal(5.5, 0.4))) + 50
        text = words(i, n, 10**6)
        if i % 20 == 0:
            text = " | ".join(text.split())
        rows.append((i, text, "en" if i % 3 else None, "src" if i < 300 else f"tiny{i % 7}"))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string")
    return rules.judged(df).collect()


def moments(x, granted):
    """The estimate of one group with numpy."""
    q = np.quantile(np.round(x, 3), [0.25, 0.5, 0.75], axis=0)
    m, s = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + granted**2)
    widen = rules.SUBSET / rules.chi_square_cdf(rules.chi_square_quantile(rules.SUBSET, 5), 7)
    for _ in range(rules.STEPS):
        far = np.round(np.log1p(distances(x, m, s)), 3)
        near = x[far <= np.quantile(far, rules.SUBSET)]
        m, s = near.mean(axis=0), (near - near.mean(axis=0)).T @ (near - near.mean(axis=0)) / len(near) * widen
        s = s + np.diag(granted**2)
    return m, s


def distances(x, m, s):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)


def leaning(n, own, wider):
    w = n / (n + rules.SHRINK)
    apart = own[0] - wider[0]
    return w * own[0] + (1 - w) * wider[0], w * own[1] + (1 - w) * wider[1] + w * (1 - w) * np.outer(apart, apart)


def vector(r):
    chars, n = max(r.word_chars, 1), r.n_words
    return [math.log1p(n), math.log(chars / n), math.sqrt(r.n_symbols / chars), 0.0, math.sqrt(r.n_repeat_words / n)]


def check_against_numpy(judged, group_of):
    granted = np.array(list(rules.GRANTED.values()))
    rs = [r for r in judged if not r.base_failed]
    x = np.array([vector(r) for r in rs])
    groups = [group_of[r.doc_id] for r in rs]
    every = moments(x, granted)
    for group in set(groups):
        mine = np.array([g == group for g in groups])
        same = np.array([g[0] == group[0] for g in groups])
        of_lang = leaning(same.sum(), moments(x[same], granted), every)
        m, s = leaning(mine.sum(), moments(x[mine], granted), of_lang)
        got = [r.distance for r, g in zip(rs, groups) if g == group]
        assert np.allclose(distances(x[mine], m, s), got, rtol=1e-6), group


def test_distances_equal_numpy(judged):
    check_against_numpy(judged, {i: (lang, source) for i, _, lang, source in corpus()})


SIZES = (1, 2, 20, 99, 100)


def test_a_group_of_any_size_is_judged_alike(spark):
    """The same far text in groups of many sizes: rejected everywhere, by distances that change
    little from one size to the next; its neighbours stay."""
    rows, group_of = [], {}
    for size in SIZES:
        for k in range(size):
            i = size * 1000 + k
            text = words(i, 150 + i % 97, 10**6)
            if k == 0:
                text = " | # ".join(words(77, 200, 10**6).split())
            rows.append((i, text, "en", f"s{size}"))
            group_of[i] = ("en", f"s{size}")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    check_against_numpy(got.values(), group_of)
    far = {size: got[size * 1000] for size in SIZES}
    assert not any(r.kept for r in far.values())
    assert all(r.kept for i, r in got.items() if i % 1000)
    assert abs(far[100].distance - far[99].distance) < 0.05 * far[99].distance


def test_outliers_go_and_clean_texts_stay(judged):
    assert len(judged) == 420
    assert all(r.kept == (r.doc_id % 20 != 0) for r in judged if not r.base_failed)
    assert not any(r.kept for r in judged if r.base_failed)


def test_small_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    few = spark.createDataFrame([(1, words(1, 60), None, None), (None, words(2, 70), "en", "s"), (2, None, "en", "s")], schema)
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judged(with_clashes(few)).collect()}
    assert got == {1: (False, True), None: (False, True), 2: (True, False)}
    assert rules.judged(empty(spark)).count() == 0


def test_chi_square():
    assert abs(rules.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(rules.chi_square_cdf(6.6257, 5) - 0.75) < 1e-4


def test_no_python_in_the_plan(spark):
    df = rules.judged(spark.createDataFrame(corpus()[:5], "doc_id bigint, text string, lang string, source string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_repeated_words_alone_are_an_outlier(spark):
    """Repeated words go in a group where no other text repeats anything; one line stays."""

    def lined(ws):
        return "\n".join(" ".join(ws[i : i + 5]) for i in range(0, len(ws), 5))

    rows = [(i, lined(words(i, 200 + i % 90, 10**6).split())) for i in range(300)]
    rows.append((1000, "only\n" * 0 + "\n".join(f"w{i}" if i % 10 == 0 else "a b" for i in range(150))))
    some = words(2000, 150, 10**6).split()
    rows.append((1001, lined(some + words(2001, 3, 10**6).split() + some[:45])))
    once = words(2002, 200, 10**6).split()
    rows.append((1002, lined(once[:195] + once[:5])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    assert all(got[i].kept for i in range(300)) and got[1002].n_dup_lines == 1 and got[1002].kept
    assert not got[1001].base_failed and got[1001].n_dup_lines == 0 and not got[1001].kept


def test_duplicate_lines_alone_are_an_outlier(spark):
    """Lines of two words have no window of three of their own, and are shuffled among others."""
    rows = [(i, "\n".join(words(i, 240, 10**6).split())) for i in range(300)]
    doubled = words(5000, 160, 10**6).split()
    rows.append((1000, "\n".join(doubled + doubled[:80][::-1])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r.doc_id: r for r in rules.judged(df).collect()}
    one = got[1000]
    assert one.n_dup_lines == 80 and one.n_repeat_words == 0 and not one.base_failed
    assert not one.kept and all(got[i].kept for i in range(300))
