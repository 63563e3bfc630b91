import os
import zlib

import pytest

from tests.llm.helpers import empty, frame, with_clashes
from vitaloom.llm import quality
from vitaloom.plans.inputs import table

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    asked = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in asked) / len(asked) > 0.95


def small(spark):
    texts = {i: ("fine words in a row" if i % 2 else "BAD!! WORDS!! HERE!!") for i in range(200)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts], "doc_id bigint, quality int, toxic int")
    return frame(spark, texts), labels


def test_same_model_every_time_and_blind_to_held_out_labels(spark):
    docs, labels = small(spark)
    first = quality.train(docs, labels)
    assert (first == quality.train(docs, labels)).all()
    turned = labels.withColumn(
        "quality",
        quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")),
    )
    assert (first == quality.train(docs, turned)).all()


def test_hard_rows(spark):
    docs, labels = small(spark)
    odd = with_clashes(
        spark.createDataFrame([(None, "fine words"), (1, None), (1, ""), (2, "word " * 30_000)], "doc_id bigint, text string")
    )
    scored = quality.with_scores(odd, quality.train(docs, labels)).collect()
    assert len(scored) == 4 and scored[1].score == scored[2].score
    assert scored[0].rep == "x" and 0 < scored[3].score < 1
    more = labels.union(spark.createDataFrame([(None, 1, 0), (5, None, None), (3, 1, 0)], labels.schema))
    assert quality.classify(docs, more).count() == 200


def test_without_labels_or_rows(spark):
    docs, labels = small(spark)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0


def plain_ftrl(rows):
    """(z, n) by slot after ROUNDS of averaged passes, one slot at a time."""
    shards = sorted({shard for shard, _, _ in rows})
    z, n = {}, {}
    for _ in range(quality.ROUNDS):
        states = []
        for shard in shards:
            own_z, own_n = dict(z), dict(n)
            for of, vector, label in rows:
                if of != shard:
                    continue
                weights = {}
                for slot in vector:
                    a, b = own_z.get(slot, 0.0), own_n.get(slot, 0.0)
                    if abs(a) > quality.L1:
                        sign = 1 if a > 0 else -1
                        weights[slot] = -(a - sign * quality.L1) / ((quality.BETA + b**0.5) / quality.ALPHA + quality.L2)
                    else:
                        weights[slot] = 0.0
                p = 1 / (1 + 2.718281828459045 ** -sum(weights[s] * x for s, x in vector.items()))
                for slot, x in vector.items():
                    g, b = (p - label) * x, own_n.get(slot, 0.0)
                    own_z[slot] = own_z.get(slot, 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / quality.ALPHA * weights[slot]
                    own_n[slot] = b + g * g
            states.append((own_z, own_n))
        z = {s: sum(a.get(s, 0.0) for a, _ in states) / len(states) for s in {s for a, _ in states for s in a}}
        n = {s: sum(b.get(s, 0.0) for _, b in states) / len(states) for s in {s for _, b in states for s in b}}
    return z, n


def test_training_equals_plain_updates(spark):
    from tests.llm.helpers import words

    texts = {i: words(i, 6, 30) + (" ok" if i % 3 else " BAD !!") for i in range(60)}
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in texts], "doc_id bigint, quality int, toxic int")
    F = quality.F
    dealt = (
        quality.sample(docs, labels, "doc_id", "text")
        .orderBy("shard", F.xxhash64("doc_id"), "doc_id", "text")
        .collect()
    )
    features, rows = quality.Features(), []
    for r in dealt:
        slots, values = features(r.text.encode())
        rows.append((r.shard, dict(zip(slots.tolist(), values.tolist())) | {quality.DIMENSIONS: 1.0}, r.label))
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in texts)
    z, n = plain_ftrl(rows)
    got = quality.train(docs, labels)
    assert set(got.nonzero()[0].tolist()) <= set(z)
    for slot, a in z.items():
        free = max(abs(a) - quality.L1, 0) * (1 if a > 0 else -1)
        want = -free / ((quality.BETA + n[slot] ** 0.5) / quality.ALPHA + quality.L2)
        assert abs(got[slot] - want) < 1e-4 * max(1, abs(want)), slot
