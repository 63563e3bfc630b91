import itertools

import pytest

from tests.llm.helpers import empty, frame, with_clashes, words
from vitaloom.llm import minhash


def brute(texts: dict) -> dict:
    sets = {}
    for i, text in texts.items():
        ws = (text or "").encode().lower().split()
        runs = [tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))] if ws else []
        sets[i] = frozenset(runs)
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def variants(base: str, n: int, step: int) -> list[str]:
    """Copies that each differ from the base in a word every so often."""
    out = []
    for k in range(n):
        ws = base.split()
        for at in range(k % step, len(ws), step):
            ws[at] = f"z{k}y{at}"
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def texts():
    long = words(1, 400)
    passage = words(2, 60)
    found = {
        1: None, 2: "", 3: " \t\n", 4: "one two", 5: "ONE two", 6: "one two three",
        7: long, 8: long.upper(), 9: long + " and more", 10: words(3, 4000), 11: "É é a b c",
        12: "é É a b c", 13: "  a b c d e",
    }
    near = [*variants(long, 12, 60), *variants(words(4, 200), 12, 45), *variants(words(5, 90), 8, 30)]
    common = [f"{passage} {words(100 + k, 30)}" for k in range(25)]
    # A chain: each link alike, the ends not.
    ws = words(6, 120).split()
    chain = [" ".join([*ws[k * 6 :], *[f"c{j}" for j in range(k * 6)]]) for k in range(6)]
    for i, text in enumerate([*near, *common, *chain]):
        found[100 + i] = text
    return found


def test_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute(texts)
    assert len({c for _, c, _ in got.values()}) < len(texts)


def test_no_id_repeated_ids_and_other_columns(spark, texts):
    rows = [(None, texts[7]), (None, texts[7]), (7, texts[7]), (7, texts[7]), (8, texts[8])]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).drop("text_hash").collect()), key=repr)
    n = len(texts[7].split()) - 4
    assert got == sorted(
        [(None, n, None, True)] * 2 + [(7, n, 7, True)] * 2 + [(8, n, 7, False)], key=repr
    )


def test_every_text_of_an_id_is_compared(spark, texts):
    """A link is found by the text of its row, whatever other texts share the id."""
    long = texts[7]
    near = long + " and more"
    for other in (words(70, 80), "zz " + words(71, 80), "a"):
        rows = [(1, long), (1, other), (2, near), (3, other), (5, words(72, 90))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True)]


def test_components_are_named_by_their_least_document(spark):
    """Sets are numbered by their hashes; the name is still the least id of any member."""
    base = words(80, 200)
    order = [9, 4, 7, 1, 8, 3]
    found = dict(zip(order, [base, *variants(base, 5, 100)]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, found)).collect()}
    assert got == {i: c for i, (_, c, _) in brute(found).items()} and set(got.values()) == {1}


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_signature_is_the_least_value_of_each_shift():
    import numpy as np

    from vitaloom.llm.common import mix

    shingles = np.unique(mix(np.arange(5000, dtype=np.uint64)))
    table = minhash._second_permutation()
    places = (mix(shingles) & np.uint64(minhash.POSITIONS - 1)).astype(int)
    order = table[:, 0]
    got = minhash.signature(shingles)
    for k in (0, 1, 77, minhash.COORDINATES - 1):
        assert got[k] == order[(places + k) % minhash.POSITIONS].min()


def test_candidates_are_linear_in_a_group(spark):
    """Many near copies of one text: links found stay few per text, the group is one."""
    texts = dict(enumerate(variants(words(9, 300), 60, 100)))
    got = minhash.near_duplicates(frame(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}
