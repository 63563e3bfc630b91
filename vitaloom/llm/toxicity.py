"""Toxicity by multiple-instance learning: labels of documents teach scores of sentences.

A document is a bag of sentences. A sentence is toxic with probability
sigmoid(OFFSET + intercept + the weights of its features), and a document is by noisy-or:
1 - the product of (1 - p) over its sentences. The gradient of a document's label reaches each
sentence in proportion to its own probability, so training settles by itself which sentences
of a toxic document are to blame; the same scores locate them afterwards.

Features of a sentence are those of its words, hashed to DIMENSIONS slots: the word in lower
case (A-Z) and its beginnings and ends of a few letters, which inflected forms share.

Training: labels that are not held out give a sample of at most SAMPLE documents, taken by a
hash of the id. Their features are computed once and stored. In each round every shard of the
sample goes through its rows once from the common state with adaptive steps and an L1 penalty,
and the shards' states are averaged. What reaches the driver is SHARDS states of fixed size;
the model is DIMENSIONS floats, the bound of what is broadcast. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import batches_of, scratch, texts_of, with_column
from vitaloom.llm.quality import held_out

DIMENSIONS = 1 << 18
SAMPLE = 20_000
SHARDS = 4
ROUNDS = 8
# A document counts as toxic from CUT on, a sentence as offending from SENTENCE_CUT on.
CUT = 0.3
SENTENCE_CUT = 0.2
# Log odds of a sentence without any evidence, before the intercept is learned.
OFFSET = -5.0
# Learning rate, its offset, the weights of both penalties.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 1.0, 0.05
# Distinct words a worker remembers the slots of, before it starts anew.
REMEMBERED = 300_000
# Letters of the beginnings and ends that are features beside the whole word.
HEADS, TAILS = (4, 6), (5,)
_WIDTH = 1 + len(HEADS) + len(TAILS)

# Bytes that end a sentence become full stops; all but letters, digits and the bytes of longer
# codes become blanks; A-Z become lower case.
_ENDS = b".!?\n\r"
_PLAIN = bytes(
    ord(".") if c in _ENDS
    else c + 32 if 65 <= c <= 90
    else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    else ord(" ")
    for c in range(256)
)


def sentences(text: bytes | None) -> list[tuple[int, int]]:
    """(start, end) in bytes of the stretches between sentence ends that hold a word."""
    out, at = [], 0
    for part in (text or b"").translate(_PLAIN).split(b"."):
        if part.strip():
            out.append((at, at + len(part)))
        at += len(part) + 1
    return out


class Features:
    """Text -> (slots, sentence sizes): _WIDTH slots a word; remembers a bounded number of words."""

    def __init__(self) -> None:
        self._numbers: dict[bytes, int] = {}
        self._table = np.zeros((1024, _WIDTH), np.int32)

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self._numbers) > REMEMBERED:
            self._numbers.clear()
        words, sizes = [], []
        for part in (text or b"").translate(_PLAIN).split(b"."):
            if found := part.split():
                words += found
                sizes.append(len(found))
        numbers = self._numbers
        if new := list(set(words).difference(numbers)):
            first, last = len(numbers), len(numbers) + len(new)
            while last > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[first:last] = [_slots(word) for word in new]
            numbers.update(zip(new, range(first, last)))
        rows = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        return self._table[rows].ravel(), np.array(sizes, np.int32)


def _slots(word: bytes) -> list[int]:
    parts = [word, *(word[:n] for n in HEADS), *(word[-n:] for n in TAILS)]
    return [xxhash.xxh32_intdigest(p, seed) % DIMENSIONS for seed, p in enumerate(parts)]


def sentence_logits(slots: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of each sentence; the last weight is the intercept."""
    if not len(sizes):
        return np.zeros(0)
    ends = np.cumsum(sizes.astype(np.int64) * _WIDTH)
    sums = np.add.reduceat(weights[slots].astype(np.float64), ends - sizes * _WIDTH)
    return np.clip(OFFSET + float(weights[DIMENSIONS]) + sums, -35, 35)


def noisy_or(logits: np.ndarray) -> float:
    """1 - the product of (1 - sigmoid(logit)); 0 without sentences."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


class Learner:
    """State of the adaptive updates: sums of adjusted gradients and of their squares."""

    def __init__(self, z: np.ndarray, n: np.ndarray) -> None:
        self.z, self.n = z.astype(np.float64), n.astype(np.float64)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        free = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -free / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def update(self, slots: np.ndarray, sizes: np.ndarray, label: int) -> None:
        """One step on the log-likelihood of a document's label."""
        if not len(sizes):
            return
        distinct, places = np.unique(np.append(slots, DIMENSIONS), return_inverse=True)
        weights = self.weights(distinct)
        ends = np.cumsum(sizes.astype(np.int64) * _WIDTH)
        sums = np.add.reduceat(weights[places[:-1]], ends - sizes * _WIDTH)
        logits = np.clip(OFFSET + weights[-1] + sums, -35, 35)
        blame = 1 / (1 + np.exp(-logits))
        if label:
            # d log(1 - q) with q the product of (1 - p): each p is weighted by q / (1 - q).
            none = np.logaddexp(0, logits).sum()
            blame = blame * -(np.exp(-none) / max(-np.expm1(-none), 1e-12))
        of_words = np.repeat(blame, sizes * _WIDTH)
        gradient = np.bincount(places, weights=np.append(of_words, blame.sum()))
        n = self.n[distinct]
        grown = n + gradient * gradient
        self.z[distinct] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * weights
        self.n[distinct] = grown


# --- training ------------------------------------------------------------------------------

_BAG = pa.schema(
    [
        ("shard", pa.int32()),
        ("doc_id", pa.int64()),
        ("label", pa.int32()),
        ("slots", pa.binary()),
        ("sizes", pa.binary()),
    ]
)
_BAG_DDL = "shard int, doc_id bigint, label int, slots binary, sizes binary"
_STORED_DDL = "doc_id bigint, label int, slots binary, sizes binary, shard int"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()

    def rows():
        for batch in batches:
            ids = (batch.column(i).to_pylist() for i in range(3))
            for shard, doc_id, label, text in zip(*ids, texts_of(batch.column(3))):
                slots, sizes = features(text)
                yield shard, doc_id, label, slots.tobytes(), sizes.tobytes()

    yield from batches_of(rows(), _BAG, 100)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(shard, doc_id, label, text): at most SAMPLE labelled documents that are not held out.

    Labels that are null, or of documents without an id, teach nothing. Of several labels of
    one document the greatest counts; of several texts of one id, each is a row.
    """
    usable = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # SAMPLE rows of two numbers: small at any size of the corpus.
    return texts.join(F.broadcast(chosen), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SHARDS)).cast("int").alias("shard"),
        "doc_id",
        "label",
        "text",
    )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of the slots and, last, the intercept; all 0 without labels."""
    spark = docs.sparkSession
    path = scratch(spark, "bags")
    made = sample(docs, labels, id_col, text_col).mapInArrow(_bags, _BAG_DDL)
    order = (F.xxhash64("doc_id"), "doc_id", "slots", "sizes")
    (
        made.repartition(SHARDS, "shard")
        .sortWithinPartitions("shard", *order)
        .write.partitionBy("shard")
        .parquet(path)
    )
    # A shard is a folder and read by one task, so that no round shuffles.
    kept = spark.read.schema(_STORED_DDL).parquet(path).select("shard", "label", "slots", "sizes")
    shards = [kept.where(F.col("shard") == i).coalesce(1) for i in range(SHARDS)]
    ordered = reduce(DataFrame.union, shards)
    z, n = np.zeros(DIMENSIONS + 1, np.float32), np.zeros(DIMENSIONS + 1, np.float32)
    for _ in range(ROUNDS):
        common = spark.sparkContext.broadcast((z, n))
        states = ordered.mapInArrow(_round(common), "shard int, z binary, n binary").collect()
        common.unpersist()
        if not states:
            break
        states.sort(key=lambda s: s.shard)
        z = np.mean([np.frombuffer(s.z, np.float32) for s in states], axis=0)
        n = np.mean([np.frombuffer(s.n, np.float32) for s in states], axis=0)
    return Learner(z, n).weights().astype(np.float32)


def _round(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None

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
            for of, label, slots, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if of != shard:
                    if shard is not None:
                        yield done()
                    shard, state = of, Learner(*common.value)
                state.update(np.frombuffer(slots, np.int32), np.frombuffer(sizes, np.int32), label)
        if shard is not None:
            yield done()

    return run


# --- scores --------------------------------------------------------------------------------

_SCORED = pa.struct(
    [
        ("score", pa.float64()),
        (
            "offending",
            pa.list_(
                pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            ),
        ),
    ]
)
_SCORED_DDL = "struct<score:double,offending:array<struct<start:int,end:int,score:double>>>"


def with_toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """`docs` with `toxicity`, a struct (score, offending), in place of any such column.

    score is the noisy-or over all sentences of the whole text. offending lists the sentences
    whose own score reaches SENTENCE_CUT: characters from start up to end, and that score. A
    null or empty text, or one without a word, has no sentence: score 0, nothing offending.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), model.value

        def of(text: bytes | None) -> dict:
            logits = sentence_logits(*features(text), w)
            scores = 1 / (1 + np.exp(-logits))
            hits = np.flatnonzero(scores >= SENTENCE_CUT).tolist()
            offending = []
            if hits:
                spans = sentences(text)
                for i in hits:
                    start = len(text[: spans[i][0]].decode())
                    end = start + len(text[spans[i][0] : spans[i][1]].decode())
                    offending.append({"start": start, "end": end, "score": float(scores[i])})
            return {"score": noisy_or(logits), "offending": offending}

        return of

    text = docs[text_col].cast("string").cast("binary")
    return with_column(docs, text, "toxicity", _SCORED, _SCORED_DDL, make)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from CUT on) and offending of every row of `docs`.

    Trains on `labels` (id, toxic). Every row is returned, also those that repeat an id or have
    none; an empty table gives an empty table. Without labels all documents get what OFFSET
    gives their number of sentences. Texts of any length are scored as a whole.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_toxicity(narrow, train(docs, labels, id_col, text_col))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= CUT).cast("int").alias("predicted"),
        F.col("toxicity.offending").alias("offending"),
    )
