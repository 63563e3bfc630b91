import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import empty, frame, rows_of, with_clashes
from vitaloom.llm import collocations
from vitaloom.llm.collocations import Summary, capacity_for


def brute(rows, least, top=2000):
    counts, sizes = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    kept = {k: f for k, f in counts.items() if f >= least}
    out = []
    for (lang, *words), a in kept.items():
        if len(words) < 2:
            continue
        n = sizes[lang]
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [
            f for (of, *other), f in kept.items()
            if of == lang and len(other) > len(words)
            and any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1))
        ]
        if all(f < a for f in longer):
            out.append((lang, -score, -a, " ".join(words).encode(), left, right, n))
    out.sort()
    ranks, result = Counter(), []
    for lang, score, a, phrase, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(result, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    fixed = ["new york city", "state of the art", "a b a b a", "Zürich ist schön", "x y z"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice("pqrsTUV") * rng.randrange(1, 3))
            parts.append(rng.choice([" ", " ", "\t", ", ", ".\n", "\x0b", "  "]))
        rows.append((rng.choice(["en", "de", None, "a b%20", "und"]), "".join(parts) if parts else rng.choice([None, ""])))
    return rows


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = collocations.collocations(with_clashes(docs).repartition(3), **how).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_equals_brute_force(spark):
    rows = made(1, 250)
    got = run(spark, rows, least=12)
    assert got == brute(rows, 12) and len({r[0] for r in got}) == 4 and len(got) > 20


def test_top_and_ties(spark):
    rows = [("en", "b a. d c. f e.")] * 6 + [("en", "z " * 50)]
    got = run(spark, rows, least=5, top=2)
    assert got == brute(rows, 5, 2) and [r[2] for r in got] == ["b a", "d c"]


def test_hard_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " \t\n..,"), ("en", "one two " * 60_000), ("en", "one two")]
    got = run(spark, rows, least=100)
    assert got == brute(rows, 100)
    assert run(spark, [("en", None)]) == []
    assert rows_of(collocations.collocations(empty(spark))) == []
    assert rows_of(collocations.collocations(frame(spark, {1: "a b"}), least=100)) == []


def test_survivors_of_a_segment_reach_its_blocks_across_batches():
    def batch(*rows):
        lists = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(lists, names=["segment", "block_id", "keys"])

    given = [
        batch((1, None, [9, 2])),
        batch((1, None, [5]), (1, 10, [1, 2, 9]), (1, 11, [3])),
        batch((1, 12, [5, 9]), (2, 10, [2, 5]), (3, None, []), (3, 10, [2])),
        batch((4, None, [7]), (4, 11, [7])),
    ]
    got = [tuple(c[0].as_py() for c in out.columns) for out in collocations._surviving(iter(given))]
    assert got == [(10, [2, 9]), (12, [5, 9]), (11, [7])]


def test_products_pass_64_bits(spark):
    frequent = spark.createDataFrame(
        [("en", "a", 1, 10**14), ("en", "b", 1, 10**14 - 7), ("en", "a b", 2, 10**13 + 1)],
        "lang string, phrase string, n_words int, f bigint",
    )
    sizes = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n bigint")
    (row,) = collocations.scored_phrases(frequent, sizes).collect()
    assert row.score == 1000 * (10**13 + 1) * 9 * 10**14 // (10**14 * (10**14 - 7))


@pytest.mark.parametrize("seed", range(6))
def test_summary_keeps_every_frequent_key_when_full(seed):
    rng = np.random.default_rng(seed)
    keys = np.concatenate([rng.integers(0, 100_000, 20_000), rng.zipf(1.5, 20_000) % 1000])
    rng.shuffle(keys)
    least = 50
    summary, other = (Summary(capacity_for(len(keys), least)) for _ in range(2))
    for i, part in enumerate(np.array_split(keys, 40)):
        one, counts = np.unique(part, return_counts=True)
        (summary if i % 2 else other).merge(one, counts)
    summary.merge(other.keys, other.counts, other.lost)
    true = Counter(keys.tolist())
    assert len(summary.keys) <= summary.capacity < len(true)
    assert 0 < summary.lost < least
    for key, count in zip(summary.keys.tolist(), summary.counts.tolist()):
        assert count <= true[key] <= count + summary.lost
    assert {k for k, f in true.items() if f >= least} <= set(summary.at_least(least).tolist())


def test_packed_keys_take_less_than_their_bits():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << collocations.KEY_BITS, 20_000))
    packed = collocations.packed_keys(keys)
    assert (collocations.unpacked_keys(packed) == keys).all()
    assert len(packed) < 5.5 * len(keys)
    for few in ([], [0], [(1 << collocations.KEY_BITS) - 1]):
        few = np.array(few, np.int64)
        assert collocations.unpacked_keys(collocations.packed_keys(few)).tolist() == few.tolist()


def test_a_task_gives_each_ngram_once(spark, monkeypatch):
    """Blocks of one task have their counts summed before they are shuffled."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 1)
    docs = spark.createDataFrame([("en", "one two")] * 30, "lang string, text string").coalesce(1)
    batches = list(docs.toArrow().to_batches())
    made = list(collocations._blocks(iter(batches)))
    assert len(made) == 30
    given = pa.Table.from_batches(collocations._counts((1, 2), False)(iter(made))).to_pylist()
    assert sorted((r["phrase"], r["f"]) for r in given) == [(b"one", 30), (b"one two", 30), (b"two", 30)]
