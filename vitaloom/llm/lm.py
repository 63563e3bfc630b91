"""Language-model scoring with a log-frequency Bloom filter of bigram counts.

1. Texts become tokenised blocks of about BLOCK_BYTES, written once: a block's own word list
   and its texts as numbers in that list. All later passes read blocks, not texts.
2. Each block gives its words with their training counts, one row a word; summed over all
   blocks by word, each block gets the exact counts of its own words, so no task and no
   broadcast ever holds the vocabulary of the corpus.
3. Each block gives the bigrams it trains with as hashes and counts, packed by SEGMENT of the
   hash. A segment's counts are summed, quantised to level q = 1 + floor(log_BASE(count)) and
   put into its part of the Bloom filter as the q entries (bigram, 1) ... (bigram, q). The
   parts are stored; they are all the model keeps of bigrams, and it grows with the corpus.
4. Scoring probes (bigram, 1), (bigram, 2), ... until a probe fails. A filter of at most
   BROADCAST_BYTES, by its measured size, is broadcast to the workers. Beyond that its parts
   stay where they are and each block's bigrams go to them by segment, the same probes giving
   the same levels.
5. A bigram's probability is smoothed by that of its word (see `smoothed`). An unseen bigram
   answers yes with a chance of FALSE_PROBES less than one in the vocabulary, so the false
   counts behind one word stay below a small part of one, and what is left is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.collocations import squeezed, unsqueezed
from vitaloom.llm.common import buckets_for, discard, mix, plain_words, stored, stored_in_buckets, texts_of
from vitaloom.llm.quality import held_out

BLOCK_BYTES = 8 << 20
BASE = 1.5
# Probes of entries beyond the first of a bigram; the first has as many as the vocabulary asks
# for, and FALSE_PROBES more. An array with BITS_PER_PROBE bits for each is half full.
PROBES = 7
FALSE_PROBES = 3
BITS_PER_PROBE = 1.4427
# Weight of the unigram estimate, in counts.
PRIOR = 5.0
BROADCAST_BYTES = 16 << 20
# Bigrams of all blocks that one segment gets, on average, at most.
SEGMENT_BIGRAMS = 2_000_000
LEAST_SEGMENTS = 64
END = b""

_BLOCK = pa.schema(
    [
        ("block_id", pa.int64()),
        ("words", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int32())),
        ("tokens", pa.binary()),
        ("n_tokens", pa.int64()),
    ]
)
_BLOCK_DDL = (
    "block_id bigint, words binary, doc_ids array<bigint>, held_out array<boolean>,"
    " lengths array<int>, tokens binary, n_tokens bigint"
)


class _Numbers(dict):
    """Word -> number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task, made = (context.partitionId() if context else 0), 0
    numbers, held, size = _Numbers({END: 0}), [], 0

    def block() -> pa.RecordBatch:
        ids, flags, tokens = zip(*held)
        row = (
            (task << 32) + made,
            b" ".join(numbers),
            list(ids),
            list(flags),
            [len(t) for t in tokens],
            squeezed(np.concatenate(tokens)),
            sum(map(len, tokens)),
        )
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist())
        for doc_id, text, out in rows:
            words = plain_words(text)
            words.append(END)
            found = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            held.append((doc_id, out, found))
            size += len(text or b"")
            if size >= BLOCK_BYTES or len(held) >= 100_000:
                yield block()
                made += 1
                numbers, held, size = _Numbers({END: 0}), [], 0
    if held:
        yield block()


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(
        F.col(id_col).cast("long"), F.col(text_col).cast("string"), held_out(id_col, 7, 2)
    )
    made = narrow.mapInArrow(_blocks, _BLOCK_DDL)
    # What is found out about a block comes to its bucket: blocks are not shuffled.
    return stored_in_buckets(made, "blocks", "block_id", buckets_for(docs))


class _Block:
    """A block row with its arrays."""

    def __init__(self, row: dict) -> None:
        self.block_id = row["block_id"]
        self.words = row["words"].split(b" ")
        self.tokens = unsqueezed(row["tokens"])
        self.lengths = np.array(row["lengths"], np.int64)
        self.doc_ids, self.held_out = row["doc_ids"], np.array(row["held_out"], bool)
        self.ends = np.cumsum(self.lengths)

    def training(self) -> np.ndarray:
        """Which tokens count."""
        return np.repeat(~self.held_out, self.lengths)

    def contexts(self) -> np.ndarray:
        """The token before each token; a text starts behind an end."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[0] = 0
        return before

    def bigrams(self) -> np.ndarray:
        """64-bit key of each token with the one before it."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        return mix(mix(hashes)[self.contexts()] ^ hashes[self.tokens])


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield _Block(row), row


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, _ in _each_block(batches):
        size = len(block.words)
        counts = np.bincount(block.tokens[block.training()], minlength=size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, block.block_id, np.int64)),
                pa.array(np.arange(size, dtype=np.int32)),
                pa.array(block.words, pa.binary()),
                pa.array(counts.astype(np.int64)),
            ],
            names=["block_id", "number", "word", "n"],
        )


def counts_of_words(made: DataFrame) -> tuple[DataFrame, int, int]:
    """(block_id, number, c, word) with the training count of each word of each block; `word` is
    null but in one row of each word. The number of training tokens, and of distinct ones."""
    rows = made.mapInArrow(_word_rows, "block_id bigint, number int, word binary, n bigint")
    of_word = Window.partitionBy("word")
    counted = stored(
        rows.withColumns(
            {
                "c": F.sum("n").over(of_word),
                "first": F.row_number().over(of_word.orderBy("block_id", "number")),
            }
        )
        .where("c > 0")
        .select("block_id", "number", "c", F.when(F.col("first") == 1, F.col("word")).alias("word")),
        "words",
    )
    n, v = counted.where("word IS NOT NULL").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return counted, n, v


# --- log-frequency Bloom filter ----------------------------------------------------------


def first_probes(vocabulary: int) -> int:
    """Probes of a bigram's first entry, so that the unseen ones behind a word, at most as many
    as the vocabulary, answer yes less than 2 ** -FALSE_PROBES times."""
    return max(PROBES, int(vocabulary).bit_length() + FALSE_PROBES)


def _steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of the probes of the entries (key, level). Each step is mixed anew: in
    small filters plain strides would run into one another."""
    start = mix(keys ^ np.uint64(level))
    return start, mix(start) | np.uint64(1)


def filter_of(keys: np.ndarray, counts: np.ndarray, probes: int) -> np.ndarray:
    """The bytes of a filter that holds the quantised counts of distinct keys."""
    levels = 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)
    set_bits = len(levels) * probes + int((levels - 1).sum()) * PROBES
    bits = np.zeros(int(set_bits * BITS_PER_PROBE) // 8 + 8, np.uint8)
    size = np.uint64(len(bits) * 8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        start, stride = _steps(keys[levels >= level], level)
        for i in range(probes if level == 1 else PROBES):
            places = mix(start + np.uint64(i) * stride) % size
            np.bitwise_or.at(bits, places >> np.uint64(3), _BIT[places & np.uint64(7)])
    return bits


_BIT = (1 << np.arange(8)).astype(np.uint8)


def levels_of(keys: np.ndarray, bits: np.ndarray, probes: int) -> np.ndarray:
    """The levels up to the first that fails; 0 where there is none."""
    levels = np.zeros(len(keys), np.int64)
    left, level, size = np.arange(len(keys)), 1, np.uint64(len(bits) * 8)
    while len(left):
        start, stride = _steps(keys[left], level)
        for i in range(probes if level == 1 else PROBES):
            places = mix(start + np.uint64(i) * stride) % size
            hit = (bits[places >> np.uint64(3)] & _BIT[places & np.uint64(7)]) != 0
            # Most keys that are not there fail at the first probes.
            start, stride, left = start[hit], stride[hit], left[hit]
        levels[left] = level
        level += 1
    return levels


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least count of each level."""
    return np.where(levels > 0, BASE ** (levels - 1.0), 0.0)


def quantised(keys: np.ndarray, bits: np.ndarray, probes: int) -> np.ndarray:
    """Counts by the levels of the keys."""
    return count_of(levels_of(keys, bits, probes))


def _squeezed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, high and low halves apart."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeezed(np.concatenate([steps >> np.uint64(32), steps & np.uint64(0xFFFFFFFF)]))


def _unsqueezed_keys(data: bytes) -> np.ndarray:
    high, low = unsqueezed(data).astype(np.uint64).reshape(2, -1)
    return np.cumsum((high << np.uint64(32)) | low, dtype=np.uint64)


def _by_segment(block: _Block, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in the order of their segments, the segment of each, and the place of
    each token's bigram in that order."""
    keys, places = np.unique(block.bigrams(), return_inverse=True)
    of = segment_of(keys, segments)
    order = np.argsort(of, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return keys[order], of[order], back[places]


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def _bigram_rows(segments: int, training: bool):
    """Blocks -> (segment, block_id, keys, counts); those that count only, if `training`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _each_block(batches):
            keys, of, places = _by_segment(block, segments)
            counts = np.bincount(places[block.training()], minlength=len(keys))
            if training:
                keys, of, counts = keys[counts > 0], of[counts > 0], counts[counts > 0]
            if not len(keys):
                continue
            present, starts = np.unique(of, return_index=True)
            ends = [*starts[1:], len(of)]
            packed = [squeezed(counts[a:b]) if training else None for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(present, pa.int64()),
                    pa.array(np.full(len(present), block.block_id, np.int64)),
                    pa.array([_squeezed_keys(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
                    pa.array(packed, pa.binary()),
                ],
                names=["segment", "block_id", "keys", "counts"],
            )

    return run


_ROWS_DDL = "segment bigint, block_id bigint, keys binary, counts binary"


def _fill(probes: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The part of the filter that a segment's bigrams make."""
        keys = np.concatenate([_unsqueezed_keys(x.as_py()) for x in table["keys"]])
        counts = np.concatenate([unsqueezed(x.as_py()) for x in table["counts"]])
        distinct, places = np.unique(keys, return_inverse=True)
        bits = filter_of(distinct, np.bincount(places, weights=counts), probes)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def _probe(probes: int):
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, parts: pa.Table) -> pa.Table:
        """The levels of each block's bigrams by the stored part of their segment."""
        bits = np.frombuffer(parts["bits"][0].as_py(), np.uint8) if parts.num_rows else None
        levels = []
        for packed in asked["keys"]:
            keys = _unsqueezed_keys(packed.as_py())
            found = np.zeros(len(keys)) if bits is None else levels_of(keys, bits, probes)
            levels.append(_squeezed_levels(found))
        return pa.table(
            {
                "block_id": asked["block_id"],
                "segment": asked["segment"],
                "levels": pa.array(levels, pa.binary()),
            }
        )

    return run


def _squeezed_levels(levels: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(levels.astype(np.uint8).tobytes())


def _unsqueezed_levels(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


@dataclass(frozen=True)
class Model:
    """What training keeps: the filter's parts (segment, bits) and how to probe them."""

    parts: DataFrame
    segments: int
    probes: int
    n_tokens: int
    vocabulary: int

    @property
    def false_mass(self) -> float:
        """Expected counts of unseen bigrams behind one word."""
        return self.vocabulary * 2.0**-self.probes


def fill(made: DataFrame, n: int, v: int) -> Model:
    """The model of training blocks with n tokens, v of them distinct."""
    segments = LEAST_SEGMENTS
    while segments * SEGMENT_BIGRAMS < n:
        segments *= 2
    probes = first_probes(v)
    rows = made.mapInArrow(_bigram_rows(segments, True), _ROWS_DDL)
    filled = rows.groupBy("segment").applyInArrow(_fill(probes), "segment bigint, bits binary")
    return Model(stored(filled, "filter"), segments, probes, n, v)


def with_levels(made: DataFrame, model: Model) -> DataFrame:
    """(block_id, levels): the levels of each block's bigrams, by segment."""
    size = model.parts.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        held = {r.segment: r.bits for r in model.parts.collect()}  # size bytes
        return made.mapInArrow(
            _probe_here(made.sparkSession.sparkContext.broadcast(held), model.segments, model.probes),
            "block_id bigint, levels array<struct<segment:bigint,levels:binary>>",
        )
    asked = made.mapInArrow(_bigram_rows(model.segments, False), _ROWS_DDL).drop("counts")
    found = (
        asked.groupBy("segment")
        .cogroup(model.parts.groupBy("segment"))
        .applyInArrow(_probe(model.probes), "block_id bigint, segment bigint, levels binary")
    )
    return found.groupBy("block_id").agg(
        F.collect_list(F.struct("segment", "levels")).alias("levels")
    )


def _probe_here(parts, segments: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = parts.value
        for block, _ in _each_block(batches):
            keys, of, _ = _by_segment(block, segments)
            present, starts = np.unique(of, return_index=True)
            rows = []
            for segment, a, b in zip(present.tolist(), starts, [*starts[1:], len(of)]):
                bits = held.get(segment)
                found = np.zeros(b - a) if bits is None else levels_of(keys[a:b], np.frombuffer(bits, np.uint8), probes)
                rows.append({"segment": segment, "levels": _squeezed_levels(found)})
            kind = pa.list_(pa.struct([("segment", pa.int64()), ("levels", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.block_id], pa.int64()), pa.array([rows], kind)], names=["block_id", "levels"]
            )

    return run


# --- scores --------------------------------------------------------------------------------

_SCORE_DDL = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


def smoothed(pairs: np.ndarray, before: np.ndarray, plain: np.ndarray, false_mass: float) -> np.ndarray:
    """Probability of a word behind another one: its count there and PRIOR times its own
    probability, over what both can sum to. Quantised counts are never above the true ones, so
    the words behind one word sum to 1 at most. A word that was never seen tells nothing."""
    return np.where(
        before > 0, (pairs + PRIOR * plain) / (before + PRIOR + false_mass), plain
    )


def _scores(model_numbers: tuple[int, int, int, float]):
    n, v, segments, false_mass = model_numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in _each_block(batches):
            counts = np.zeros(len(block.words))
            counts[np.array(row["numbers"] or [], np.int64)] = row["counts"] or []
            plain = (counts + 1) / (n + v + 1)
            _, _, places = _by_segment(block, segments)
            parts = sorted((x["segment"], x["levels"]) for x in row["levels"])
            found = count_of(np.concatenate([_unsqueezed_levels(x) for _, x in parts]).astype(np.int64))
            before, after = counts[block.contexts()], counts[block.tokens]
            pairs = np.minimum(found[places], np.minimum(before, after))
            mixed = smoothed(pairs, before, plain[block.tokens], false_mass)
            starts = block.ends - block.lengths
            sums = [
                np.add.reduceat(values, starts)
                for values in (
                    (after > 0).astype(np.int64),
                    np.log10(plain)[block.tokens],
                    np.log10(mixed),
                )
            ]
            size = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, pa.int64()),
                    pa.array(block.held_out),
                    pa.array(block.lengths),
                    pa.array(sums[0]),
                    pa.array(np.full(size, n, np.int64)),
                    pa.array(sums[1]),
                    pa.array(sums[2]),
                ],
                names=[c.split()[0] for c in _SCORE_DDL.split(", ")],
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Texts whose crc32 (of the id as text) leaves rest 2 by 7 are held out of training; a row
    without an id is not. Tokens are the words in lower case (A-Z) and one end; a null or
    empty text is one end. base_score is the add-one unigram log10 probability by exact
    counts; score is that of the smoothed bigram model. Rows that repeat an id are scored
    and counted one by one; a text of any length is scored as a whole, in one block; an empty
    table gives an empty table.
    """
    made = blocks(docs, id_col, text_col)
    words, n, v = counts_of_words(made)
    model = fill(made, n, v)
    levels = stored(with_levels(made, model), "levels")
    counts = words.groupBy("block_id").agg(
        F.collect_list("number").alias("numbers"), F.collect_list("c").alias("counts")
    )
    scored = stored(
        made.join(counts, "block_id", "left")
        .join(levels, "block_id")
        .mapInArrow(_scores((n, v, model.segments, model.false_mass)), _SCORE_DDL),
        "scores",
    )
    discard(made, words, model.parts, levels)
    return scored
