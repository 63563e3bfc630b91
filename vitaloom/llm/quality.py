"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Features are n-grams of one and two words, hashed to DIMENSIONS slots: of the words in lower
case, and of their shapes (case pattern, digits and punctuation, runs shortened), a pair also
telling whether its two words are equal. A text's vector holds log(1 + count), scaled to unit
length, so its score is one sparse dot product whatever the length of the text.

Training: labels that are not held out give a sample of at most SAMPLE rows, taken by a hash
of the id, the same on every run. The sample is dealt to SHARDS; in each round every shard
goes through its rows once from the common state and the shards' states are averaged
(iterative parameter mixing). What reaches the driver is SHARDS states of fixed size; the
model is DIMENSIONS floats, the bound of what is broadcast. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import (
    REMEMBERED_WORDS,
    WordHashes,
    mix,
    plain_words,
    stored,
    texts_of,
    with_column,
)

DIMENSIONS = 1 << 18
SAMPLE = 20_000
SHARDS = 4
ROUNDS = 8
CUT = 0.7
# FTRL-proximal: learning rate, its offset, and the weights of both penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1


# Bytes to classes: capitals, other letters (all of a longer code among them), digits; the
# rest stand for themselves.
_CLASSES = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128
    else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)


class _ShapeHashes(dict):
    """Classes of a word's bytes -> hash of its shape, in which runs count once; bounded."""

    def __missing__(self, classes: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        shape = re.sub(rb"(.)\1+", rb"\1", classes)[:12]
        value = self[classes] = xxhash.xxh64_intdigest(shape, 1)
        return value


class Features:
    """Text -> (slots, values); remembers a bounded number of words."""

    def __init__(self) -> None:
        self.words, self.shapes = WordHashes(), _ShapeHashes()

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        plain = self.words.of(plain_words(text))
        if not len(plain):
            return np.zeros(0, np.int64), np.zeros(0)
        of_shape = map(self.shapes.__getitem__, text.translate(_CLASSES).split())
        shapes = np.fromiter(of_shape, np.uint64, len(plain))
        same = (plain[1:] == plain[:-1]).astype(np.uint64)
        grams = np.concatenate(
            [
                mix(plain),
                mix(shapes),
                mix(mix(plain[:-1]) ^ plain[1:]),
                mix(mix(mix(shapes[:-1]) ^ shapes[1:]) ^ same),
            ]
        )
        slots, counts = np.unique(
            (grams & np.uint64(DIMENSIONS - 1)).astype(np.int32), return_counts=True
        )
        values = np.log1p(counts)
        return slots, values / np.sqrt((values * values).sum())


class Ftrl:
    """State of the updates: sums of adjusted gradients and of their squares."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        self.z = np.zeros(DIMENSIONS + 1) if z is None else z.astype(np.float64)
        self.n = np.zeros(DIMENSIONS + 1) if n is None else n.astype(np.float64)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        free = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -free / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def update(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(slots)
        gradient = (sigmoid((weights * values).sum()) - label) * values
        n = self.n[slots]
        grown = n + gradient * gradient
        self.z[slots] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * weights
        self.n[slots] = grown


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def held_out(id_col: str = "doc_id", parts: int = 4, rest: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of the id as text; a null id is not."""
    text = F.col(id_col).cast("long").cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % parts == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(shard, doc_id, text, label): at most SAMPLE labelled rows that are not held out.

    Labels that are null, or of documents without an id, teach nothing. Of several labels of
    one document the least counts; of several texts of one id, each is a row.
    """
    usable = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # SAMPLE rows of two numbers: small at any size of the corpus.
    return texts.join(F.broadcast(chosen), "doc_id").select(
        (F.abs(F.xxhash64("doc_id", F.lit(7))) % SHARDS).cast("int").alias("shard"),
        "doc_id",
        "text",
        "label",
    )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights and, last, the intercept. Without labels all are 0, so all scores are 0.5."""
    spark = docs.sparkSession
    rows = stored(sample(docs, labels, id_col, text_col), "sample")
    dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions(
        "shard", F.xxhash64("doc_id"), "doc_id", "text"
    ).select("shard", "text", "label")
    z, n = np.zeros(DIMENSIONS + 1, np.float32), np.zeros(DIMENSIONS + 1, np.float32)
    for _ in range(ROUNDS):
        common = spark.sparkContext.broadcast((z, n))
        states = dealt.mapInArrow(_round(common), "shard int, z binary, n binary").collect()
        common.unpersist()
        if not states:
            break
        z = np.mean([np.frombuffer(s.z, np.float32) for s in states], axis=0)
        n = np.mean([np.frombuffer(s.n, np.float32) for s in states], axis=0)
    return Ftrl(z, n).weights().astype(np.float32)


def _with_intercept(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(slots, DIMENSIONS), np.append(values, 1.0)


def _round(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, shard, state = Features(), None, None

        def done():
            return pa.record_batch(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([state.z.astype(np.float32).tobytes()], pa.binary()),
                    pa.array([state.n.astype(np.float32).tobytes()], pa.binary()),
                ],
                names=["shard", "z", "n"],
            )

        for batch in batches:
            rows = zip(
                batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()
            )
            for of, text, label in rows:
                if of != shard:
                    if shard is not None:
                        yield done()
                    shard, state = of, Ftrl(*common.value)
                state.update(*_with_intercept(*features(text)), label)
        if shard is not None:
            yield done()

    return run


def with_scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1), in place of any such column, by the text alone.

    A null or empty text has no n-gram and gets the score of the intercept. A text of any length
    is scored as a whole; repeated rows are scored one by one; an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), model.value

        def of(text: bytes | None) -> float:
            slots, values = features(text)
            return float(sigmoid((w[slots] * values).sum() + w[-1]))

        return of

    text = docs[text_col].cast("string").cast("binary")
    return with_column(docs, text, "score", pa.float64(), "double", make)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from CUT on) of every row of `docs`.

    Trains on `labels` (id, quality). Every row is returned, also those that repeat an id or
    have none; an empty table gives an empty table.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_scores(narrow, train(docs, labels, id_col, text_col))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
