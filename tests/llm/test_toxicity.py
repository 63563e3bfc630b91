import os
import zlib

import numpy as np
import pytest

from tests.llm.helpers import empty, frame, with_clashes, words
from vitaloom.llm import toxicity
from vitaloom.plans.inputs import table

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    asked = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    caught = [p for p, y in asked if y == 1]
    clean = [1 - p for p, y in asked if y == 0]
    assert sum(caught) / len(caught) > 0.8 and sum(clean) / len(clean) > 0.95


def bags(spark, n=400):
    """Clean sentences of random words; one sentence of a toxic document holds an insult."""
    texts = {}
    for i in range(n):
        parts = [words(i * 7 + j, 8) for j in range(1 + i % 5)]
        if i % 4 == 0:
            parts[i % len(parts)] = words(i, 4) + " you dimwit " + words(i + 1, 3)
        texts[i] = ". ".join(parts) + "."
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in texts], "doc_id bigint, quality int, toxic int")
    return texts, frame(spark, texts), labels


def test_offending_sentences_are_located(spark):
    texts, docs, labels = bags(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    wrong = [i for i in texts if got[i].predicted != int(i % 4 == 0)]
    assert len(wrong) < 8
    located = [i for i in texts if i % 4 == 0 and len(got[i].offending) == 1]
    assert len(located) > 90
    for i in located:
        (x,) = got[i].offending
        assert "dimwit" in texts[i][x.start : x.end] and "." not in texts[i][x.start : x.end]
        assert got[i].score >= x.score - 1e-9


def test_noisy_or_and_gradient():
    logits = np.array([-2.0, 0.3, 1.0])
    p = 1 / (1 + np.exp(-logits))
    assert abs(toxicity.noisy_or(logits) - (1 - np.prod(1 - p))) < 1e-12
    assert toxicity.noisy_or(np.zeros(0)) == 0
    # The step of one update against the numeric gradient of the log-likelihood.
    features = toxicity.Features()
    slots, sizes = features(b"one two. three one! four")
    for label in (0, 1):
        size = toxicity.DIMENSIONS + 1
        rng = np.random.default_rng(1)
        z = rng.normal(0, 3, size)
        learner = toxicity.Learner(z.copy(), np.zeros(size))
        w = learner.weights()

        def loss(weights):
            score = toxicity.noisy_or(toxicity.sentence_logits(slots, sizes, weights))
            return -np.log(score if label else 1 - score)

        learner.update(slots, sizes, label)
        for slot in (*set(slots.tolist()), toxicity.DIMENSIONS):
            step = np.zeros(size)
            step[slot] = 1e-6
            numeric = (loss(w + step) - loss(w - step)) / 2e-6
            exact = np.sqrt(learner.n[slot])
            assert abs(abs(numeric) - exact) < 1e-4 * max(1, exact)
            moved = learner.z[slot] - z[slot]
            expected = numeric - exact / toxicity.ALPHA * w[slot]
            assert abs(moved - expected) < 1e-3 * max(1, abs(expected))


def test_scores_equal_plain_python(spark):
    texts, docs, labels = bags(spark, 120)
    weights = toxicity.train(docs, labels)
    assert (weights == toxicity.train(docs, labels)).all()
    scored = toxicity.with_toxicity(docs, weights).collect()
    for r in scored[:40]:
        none = 1.0
        for part in texts[r.doc_id].lower().split("."):
            if part.split():
                total = sum(float(weights[s]) for w in part.split() for s in toxicity._slots(w.encode()))
                none *= 1 - 1 / (1 + np.exp(-(toxicity.OFFSET + float(weights[-1]) + total)))
        assert abs(r.toxicity.score - (1 - none)) < 1e-9


def test_blind_to_held_out_labels_and_hard_rows(spark):
    texts, docs, labels = bags(spark, 120)
    weights = toxicity.train(docs, labels)
    turned = labels.withColumn(
        "toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))
    )
    assert (weights == toxicity.train(docs, turned)).all()
    odd = with_clashes(
        spark.createDataFrame(
            [(None, "you dimwit"), (1, None), (1, ""), (2, "word. " * 30_000), (3, "... !?"), (4, "ä é dimwit. Ж")],
            "doc_id bigint, text string",
        )
    ).withColumn("toxicity", toxicity.F.lit("mine"))
    got = toxicity.with_toxicity(odd, weights).collect()
    assert len(got) == 6 and got[0].score == "x"
    by_id = {(r.doc_id, r.text): r.toxicity for r in got}
    assert by_id[(1, None)].score == by_id[(1, "")].score == by_id[(3, "... !?")].score == 0
    assert all(0 <= x.score <= 1 for x in by_id.values())
    more = labels.union(spark.createDataFrame([(None, 1, 1), (5, 1, None), (3, 1, 0), (3, 1, 7)], labels.schema))
    assert toxicity.classify(docs, more).count() == 120
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.classify(empty(spark), labels).count() == 0
