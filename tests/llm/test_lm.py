import collections
import math
import zlib

import numpy as np

from tests.llm.helpers import empty, with_clashes, words
from vitaloom.llm import lm


def test_scores_against_brute_force(spark):
    rows = [(i, words(i % 30, 20 + i, 50)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "unseen words only here"), (None, "w1x1 W1X1"), (5, words(5, 25, 50)), (204, "É é"), (205, "long " * 20_000)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [((text or "").encode().lower().split()) + [b""] for _, text in rows]
    counts = collections.Counter(t for (i, _), ts in zip(rows, tokens) if not out(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        [
            (i, out(i), len(ts), sum(counts[t] > 0 for t in ts), n,
             round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6))
            for (i, _), ts in zip(rows, tokens)
        ],
        key=repr,
    )
    got = lm.score(df).collect()
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6)) for r in got], key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 120]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_empty_table(spark):
    assert lm.score(empty(spark)).count() == 0


def test_filter_gives_quantised_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    probes = lm.first_probes(1000)
    bits = lm.filter_of(keys, counts, probes)
    found = lm.quantised(keys, bits, probes)
    # Never less than the level stored, which is the count within a factor of BASE.
    assert (found * lm.BASE > counts * 0.999).all()
    assert (found <= counts).mean() > 0.97
    other = np.setdiff1d(rng.integers(0, 2**63, 200_000).astype(np.uint64), keys)
    yes = (lm.quantised(other, bits, probes) > 0).mean()
    assert yes < 2 * 2.0**-probes + 1e-4
    assert len(lm.filter_of(keys[:0], counts[:0], probes)) == 8


def test_filter_grows_with_its_entries_and_the_vocabulary():
    keys, ones = np.arange(10_000, dtype=np.uint64), np.ones(10_000)
    sizes = [len(lm.filter_of(keys[:k], ones[:k], 20)) for k in (10, 1000, 10_000)]
    assert sizes[0] < sizes[1] / 50 < sizes[2] / 250
    assert lm.first_probes(10**6) == 20 + lm.FALSE_PROBES < lm.first_probes(10**9)
    assert 10**6 * 2.0 ** -lm.first_probes(10**6) <= 2.0**-lm.FALSE_PROBES


def exact_scores(rows):
    """The same model by exact counts, quantised as the filter does."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [(i, [b"", *(t or "").encode().lower().split(), b""]) for i, t in rows]
    words, pairs = collections.Counter(), collections.Counter()
    for i, ts in texts:
        if not out(i):
            words.update(ts[1:])
            pairs.update(zip(ts, ts[1:]))
    n, v = sum(words.values()), len(words)
    false_mass = v * 2.0 ** -lm.first_probes(v)

    def probability(a, b):
        plain = (words[b] + 1) / (n + v + 1)
        if not words[a]:
            return plain
        c = pairs[a, b]
        count = lm.BASE ** math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) if c else 0
        return (count + lm.PRIOR * plain) / (words[a] + lm.PRIOR + false_mass)

    return [sum(math.log10(probability(a, b)) for a, b in zip(ts, ts[1:])) for _, ts in texts], words, probability


def test_score_equals_exact_counts(spark, monkeypatch):
    rows = [(i, words(i % 25, 15 + i % 40, 60)) for i in range(150)] + [(200, None), (201, "never seen"), (202, "z " * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, vocabulary, probability = exact_scores(rows)
    for most in (lm.BROADCAST_BYTES, 0):  # broadcast, and sent to the parts
        monkeypatch.setattr(lm, "BROADCAST_BYTES", most)
        got = {r.doc_id: r.score for r in lm.score(df).collect()}
        # A false answer can only raise a score: a level of a seen bigram in 2 ** PROBES answers.
        higher = [got[i] - x for (i, _), x in zip(rows, want)]
        tokens = sum(len((t or "").split()) + 1 for _, t in rows[:150])
        assert min(higher) > -1e-6 and sum(higher[:150]) < tokens * 3 * 2**-lm.PROBES * math.log10(lm.BASE)
        assert max(higher[150:152]) < 1e-6
    # What may follow a word sums to 1 at most; one place is left for words never seen.
    for a in list(vocabulary)[:40]:
        total = sum(probability(a, b) for b in vocabulary) + probability(a, b"\x00never")
        assert 0.5 < total <= 1 + 1e-9


def test_seen_and_unseen_bigrams_differ(spark):
    rows = [(i, words(i, 400, 50)) for i in range(200)] + [(1000, words(7, 400, 50))]
    shuffled = words(7, 400, 50).split()
    np.random.default_rng(1).shuffle(shuffled)
    rows.append((next(i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2), " ".join(shuffled)))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen, unseen = got[1000], got[rows[-1][0]]
    assert seen.base_score == unseen.base_score or math.isclose(seen.base_score, unseen.base_score)
    assert seen.score - unseen.score > 50
    pairs = collections.Counter(p for i, t in rows[:-1] if not got[i].held_out for p in zip(t.split(), t.split()[1:]))
    fresh = sum(pairs[p] == 0 for p in zip(shuffled, shuffled[1:]))
    assert fresh > 200
