"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly.

1. Texts become blocks of about BLOCK_BYTES: a list of (language, word) and the text as numbers
   in that list, 0 where a piece ends. All later passes read blocks. These are stored in buckets
   by block, so that what is found out about a block comes to it and no block is shuffled.
2. A level takes n-grams of some lengths: single words, then pairs, then 3 to MOST_WORDS words.
   Each block gives its distinct n-grams as hashes with their counts, packed by SEGMENT of the
   hash. The segments' masses are summed first. A segment's rows are then merged, as a stream,
   into one Misra-Gries summary of more counters than mass / LEAST: when it is full, the
   greatest count that does not fit is taken off all. What a summary can have lost of a count
   is below LEAST, so every n-gram that occurs LEAST times is still in it, whatever the order
   of the rows. The number of segments grows with the mass, so a summary does not.
3. Each block's n-grams are held against the survivors of their segment, and those that are
   left go back to the block. There their occurrences are counted by the
   words themselves, summed over all blocks and held against LEAST. These counts are exact;
   hashes that meet only cost a count that is then dropped.
4. Between levels a block is cut down: an n-gram of LEAST occurrences has no word and no pair
   of fewer, so words that did not survive end a piece, and so do pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import batches_of, buckets_for, discard, mix, stored, stored_in_buckets, texts_of

LEAST = 100
MOST_WORDS = 5
TOP = 2000
UNKNOWN = "und"
BLOCK_BYTES = 8 << 20
# n-grams that one segment gets on average, at most; its summary has about 1 / LEAST as many
# counters.
SEGMENT_MASS = 20_000_000
LEAST_SEGMENTS = 32
# Entries that wait for a merge into the summary of a segment.
WAITING = 500_000
# Counted n-grams that a task holds before it gives them on.
HELD_COUNTS = 200_000

# Bytes that end a piece become full stops, tabs blanks, and A-Z lower case.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(
    ord(".") if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)

_BLOCK = pa.schema([("block_id", pa.int64()), ("words", pa.list_(pa.binary())), ("tokens", pa.binary())])
_BLOCK_DDL = "block_id bigint, words array<binary>, tokens binary"


def squeezed(tokens: np.ndarray) -> bytes:
    """Numbers in few bytes: equal bytes of all numbers side by side, then compressed."""
    planes = tokens.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


# Bits of an n-gram's hash. n-grams that meet are told apart by their words in the end.
KEY_BITS = 48


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys in few bytes: the steps from one to the next, which are smaller the more
    keys there are, as `squeezed` does it."""
    steps = np.diff(keys.view(np.int64), prepend=np.int64(0)).astype("<i8")
    planes = steps.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = planes.reshape(KEY_BITS // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : KEY_BITS // 8] = planes.T
    return np.cumsum(steps.view("<i8").ravel())


def pieces(text: bytes | None) -> list[bytes]:
    """Lower-cased words in order, with b"." between pieces; no word holds a full stop."""
    return (text or b"").translate(_PLAIN).replace(b".", b" . ").split()


class _Numbers(dict):
    """Word of one language -> number in its block; both kept in the block's list."""

    def __init__(self, lang: bytes, words: list[bytes]) -> None:
        super().__init__({b".": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(self.lang + b" " + word)
        return number


def _lang_key(lang: bytes) -> bytes:
    """A language as one word: blanks, which no word here may have, are percent-coded."""
    return lang.replace(b"%", b"%25").replace(b" ", b"%20")


def _lang_of(key: bytes) -> str:
    return key.replace(b"%20", b" ").replace(b"%25", b"%").decode()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> blocks. Entry 0 of a block's list stands for the end of a piece."""
    context = TaskContext.get()
    task, made = (context.partitionId() if context else 0), 0
    words, numbers, held, size = [b""], {}, [], 0

    def block() -> pa.RecordBatch:
        row = ((task << 32) + made, words, squeezed(np.concatenate(held)))
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

    for batch in batches:
        for lang, text in zip(texts_of(batch.column(0)), texts_of(batch.column(1))):
            if not text:
                continue
            of = numbers.get(lang)
            if of is None:
                of = numbers[lang] = _Numbers(_lang_key(lang), words)
            found = pieces(text)
            found.append(b".")
            held.append(np.fromiter(map(of.__getitem__, found), np.uint32, len(found)))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield block()
                made += 1
                words, numbers, held, size = [b""], {}, [], 0
    if held:
        yield block()


def blocks(docs: DataFrame, lang_col: str, text_col: str, buckets: int) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    narrow = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    made = narrow.mapInArrow(_blocks, _BLOCK_DDL)
    return stored_in_buckets(made, "phrase-blocks", "block_id", buckets)


# --- n-grams of a block --------------------------------------------------------------------


class _Block:
    def __init__(self, words: list[bytes], tokens: np.ndarray) -> None:
        self.words, self.tokens = words, tokens.astype(np.int64)

    def places(self, n: int) -> np.ndarray:
        """Where n words of one piece follow one another."""
        size = len(self.tokens) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        inside = np.ones(size, bool)
        for i in range(n):
            inside &= self.tokens[i : size + i] != 0
        return np.flatnonzero(inside)

    @cached_property
    def hashes(self) -> np.ndarray:
        return mix(np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)))

    def keys(self, n: int, places: np.ndarray) -> np.ndarray:
        """Hash of KEY_BITS bits of the n words at each place, and of n."""
        out = np.full(len(places), n, np.uint64)
        for i in range(n):
            out = mix(out) ^ self.hashes[self.tokens[places + i]]
        return mix(out) >> np.uint64(64 - KEY_BITS)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["block_id"], _Block(row["words"], unsqueezed(row["tokens"])), row


_PACKED_DDL = "block_id bigint, segment bigint, mass bigint, keys binary, counts binary"


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS // 2)) % np.uint64(segments)).astype(np.int64)


def _packed(lengths: tuple[int, ...], segments: int):
    """Blocks -> their distinct n-grams and counts, a row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_id, block, _ in _each_block(batches):
            found = np.concatenate([block.keys(n, block.places(n)) for n in lengths])
            keys, counts = np.unique(found, return_counts=True)
            of = segment_of(keys, segments)
            order = np.argsort(of, kind="stable")
            keys, counts, of = keys[order].view(np.int64), counts[order], of[order]
            present, starts = np.unique(of, return_index=True)
            bounds = np.append(starts, len(of)).tolist()
            sums = np.add.reduceat(counts, starts) if len(starts) else counts
            ranges = list(zip(bounds, bounds[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(present), block_id, np.int64)),
                    pa.array(present, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array([packed_keys(keys[a:b]) for a, b in ranges], pa.binary()),
                    pa.array([squeezed(counts[a:b]) for a, b in ranges], pa.binary()),
                ],
                names=["block_id", "segment", "mass", "keys", "counts"],
            )

    return run


def _masses(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, _ in _each_block(batches):
            mass = sum(len(block.places(n)) for n in lengths)
            yield pa.record_batch([pa.array([mass], pa.int64())], names=["mass"])

    return run


# --- Misra-Gries summaries -----------------------------------------------------------------


class Summary:
    """A Misra-Gries summary of at most `capacity` counters that takes counted keys.

    A key's true count is between its counter and its counter + `lost`; `lost` is at most the
    mass taken in divided by (capacity + 1). Merging the counters of another summary and adding
    its `lost` keeps both statements.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        self.lost += lost
        self.keys, places = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.zeros(len(self.keys), np.int64)
        np.add.at(sums, places, np.concatenate([self.counts, counts]))
        if len(sums) > self.capacity:
            cut = len(sums) - self.capacity - 1
            off = int(np.partition(sums, cut)[cut])
            left = sums > off
            self.keys, sums = self.keys[left], sums[left] - off
            self.lost += off
        self.counts = sums

    def at_least(self, least: int) -> np.ndarray:
        """The keys that may have `least` occurrences; all that have are among them."""
        return self.keys[self.counts + self.lost >= least]


def capacity_for(mass: int, least: int) -> int:
    """Counters enough that less than `least` is ever lost."""
    return mass // least + 1


def _summaries(least: int):
    """(segment, mass, keys, counts) in the order of segments, where a segment's whole mass comes
    before its keys -> (segment, survivors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, summary, waiting, size = None, None, [], 0

        def take():
            nonlocal waiting, size
            if waiting:
                summary.merge(*(np.concatenate(c) for c in zip(*waiting)))
            waiting, size = [], 0

        def survivors():
            found = summary.at_least(least)
            for start in range(0, len(found), 50_000):
                part = packed_keys(found[start : start + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int64()), pa.array([part], pa.binary())],
                    names=["segment", "keys"],
                )

        for batch in batches:
            for i in range(batch.num_rows):
                if (of := batch.column(0)[i].as_py()) != segment:
                    if summary:
                        take()
                        yield from survivors()
                    segment = of
                    summary = Summary(capacity_for(batch.column(1)[i].as_py(), least))
                    continue
                keys = unpacked_keys(batch.column(2)[i].as_py())
                counts = unsqueezed(batch.column(3)[i].as_py()).astype(np.int64)
                waiting.append((keys, counts))
                size += len(keys)
                if size >= WAITING:
                    take()
        if summary:
            take()
            yield from survivors()

    return run


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, block_id, keys) in the order of segments, where a segment's survivors come before
    its blocks and have no block -> (block_id, the keys that survive)."""
    segment, parts, survivors = None, [], np.zeros(0, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            of, block_id = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            keys = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
            if of != segment:
                segment, parts, survivors = of, [], np.zeros(0, np.int64)
            if block_id is None:
                parts.append(keys)
                continue
            if parts:
                survivors, parts = np.sort(np.concatenate(parts)), []
            if not len(survivors):
                continue
            at = np.searchsorted(survivors, keys)
            found = keys[survivors[np.minimum(at, len(survivors) - 1)] == keys]
            if len(found):
                bounds = pa.array(np.array([0, len(found)], np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block_id], pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(found))],
                    names=["block_id", "keys"],
                )


def _surviving_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `_surviving`, of packed keys."""

    def unpacked() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = unpacked_keys(batch.column(2)[i].as_py())
                bounds = pa.array(np.array([0, len(keys)], np.int32))
                row = [*batch.slice(i, 1).columns[:2], pa.ListArray.from_arrays(bounds, pa.array(keys))]
                yield pa.RecordBatch.from_arrays(row, names=["segment", "block_id", "keys"])

    yield from _surviving(unpacked())


def _by_segment(first: DataFrame, rest: DataFrame) -> DataFrame:
    """The rows of both by segment, those of `first` before the others.

    One plain exchange at any size, where a join would be a broadcast at one and a shuffle of
    single keys at the other.
    """
    both = first.withColumn("_turn", F.lit(0)).unionByName(
        rest.withColumn("_turn", F.lit(1)), allowMissingColumns=True
    )
    return both.repartition("segment").sortWithinPartitions("segment", "_turn")


def survivors_by_block(
    made: DataFrame, lengths: tuple[int, ...], least: int, buckets: int
) -> tuple[DataFrame, list[DataFrame]]:
    """(block_id, survivors): the n-grams of each block that may occur `least` times in all, dealt
    as the blocks are; and the stored tables this reads."""
    mass = made.mapInArrow(_masses(lengths), "mass bigint").agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]
    segments = LEAST_SEGMENTS
    while segments * SEGMENT_MASS < mass:
        segments *= 2
    rows = stored(made.mapInArrow(_packed(lengths, segments), _PACKED_DDL), "ngrams")
    masses = rows.groupBy("segment").agg(F.sum("mass").alias("mass"))
    kept = stored(
        _by_segment(masses, rows.select("segment", "keys", "counts"))
        .select("segment", "mass", "keys", "counts")
        .mapInArrow(_summaries(least), "segment bigint, keys binary"),
        "survivors",
    )
    found = (
        _by_segment(kept, rows.select("segment", "block_id", "keys"))
        .select("segment", "block_id", "keys")
        .mapInArrow(_surviving_packed, "block_id bigint, keys array<bigint>")
        .repartition(buckets, "block_id")
        .groupBy("block_id")
        .agg(F.flatten(F.collect_list("keys")).alias("survivors"))
    )
    return found, [rows, kept]


# --- cutting blocks down, counting ---------------------------------------------------------


def _sorted_survivors(row: dict) -> np.ndarray:
    return np.sort(np.array(row["survivors"] or [], np.int64)).view(np.uint64)


def _among(keys: np.ndarray, survivors: np.ndarray) -> np.ndarray:
    return np.isin(keys.view(np.int64), survivors.view(np.int64))


def _cut_to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks without the words that did not survive; what they stood between is apart."""
    for block_id, block, row in _each_block(batches):
        everything = np.arange(len(block.words))
        single = _Block(block.words, everything)
        left = np.zeros(len(block.words), bool)
        left[1:] = _among(single.keys(1, everything[1:]), _sorted_survivors(row))
        yield _rewritten(block_id, block, np.where(left[block.tokens], block.tokens, 0))


def _cut_to_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks cut between neighbours that are no surviving pair, without single words."""
    for block_id, block, row in _each_block(batches):
        places = block.places(2)
        places = places[_among(block.keys(2, places), _sorted_survivors(row))]
        joined = np.zeros(len(block.tokens) + 1, bool)  # whether a token goes on with the next
        joined[places] = True
        goes_on, comes_after = joined[:-1], np.concatenate([[False], joined[:-2]])
        kept = goes_on | comes_after
        # A token behind which the text is cut is followed by an end.
        out = np.zeros((len(block.tokens), 2), np.int64)
        out[:, 0] = np.where(kept, block.tokens, 0)
        use = np.ones(out.shape, bool)
        use[:, 0] = kept
        use[:, 1] = kept & ~goes_on
        yield _rewritten(block_id, block, out[use])


def _rewritten(block_id: int, block: _Block, tokens: np.ndarray) -> pa.RecordBatch:
    """The block with these tokens, runs of ends as one, and the words they use."""
    ends = tokens == 0
    tokens = tokens[~(ends & np.concatenate([[True], ends[:-1]]))] if len(tokens) else tokens
    used, numbers = np.unique(np.append(tokens, 0), return_inverse=True)
    row = (block_id, [block.words[i] for i in used], squeezed(numbers[:-1]))
    return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)


_COUNTED = pa.schema(
    [("lang", pa.string()), ("phrase", pa.binary()), ("n_words", pa.int32()), ("f", pa.int64())]
)


def _counts(lengths: tuple[int, ...], chosen: bool):
    """Blocks -> counts of their n-grams by the words; only of the row's survivors if `chosen`.

    A task's blocks have most frequent n-grams in common, so their counts are summed before they
    are given on, as long as there are at most HELD_COUNTS n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: dict[tuple, int] = {}
            for _, block, row in _each_block(batches):
                survivors = _sorted_survivors(row) if chosen else None
                langs, words = [], []
                for entry in block.words:
                    lang, _, word = entry.partition(b" ")
                    langs.append(_lang_of(lang))
                    words.append(word)
                for n in lengths:
                    places = block.places(n)
                    if chosen:
                        places = places[_among(block.keys(n, places), survivors)]
                    if not len(places):
                        continue
                    # Rows of numbers as single values, so that equal n-grams are equal.
                    grams = np.stack([block.tokens[places + i] for i in range(n)], axis=1)
                    distinct, counts = np.unique(grams, axis=0, return_counts=True)
                    for gram, count in zip(distinct.tolist(), counts.tolist()):
                        key = langs[gram[0]], b" ".join([words[i] for i in gram]), n
                        held[key] = held.get(key, 0) + count
                        if len(held) >= HELD_COUNTS:
                            yield from ((*k, c) for k, c in held.items())
                            held.clear()
            yield from ((*k, c) for k, c in held.items())

        yield from batches_of(rows(), _COUNTED, 20_000)

    return run


def counted(made: DataFrame, lengths: tuple[int, ...], least: int, chosen: bool = False) -> DataFrame:
    """(lang, phrase, n_words, f) of the n-grams of these blocks that occur `least` times."""
    rows = made.mapInArrow(
        _counts(lengths, chosen), "lang string, phrase binary, n_words int, f bigint"
    )
    return (
        rows.groupBy("lang", "phrase", "n_words")
        .agg(F.sum("f").alias("f"))
        .where(F.col("f") >= least)
        .select("lang", F.col("phrase").cast("string").alias("phrase"), "n_words", "f")
    )


def _words_of(made: DataFrame) -> DataFrame:
    """(lang, n): how many words each language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, _ in _each_block(batches):
            counts = np.bincount(block.tokens, minlength=len(block.words))
            sums: dict[str, int] = {}
            for entry, count in zip(block.words[1:], counts[1:].tolist()):
                lang = entry.partition(b" ")[0]
                sums[lang] = sums.get(lang, 0) + count
            yield pa.record_batch(
                [pa.array([_lang_of(k) for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())],
                names=["lang", "n"],
            )

    return made.mapInArrow(run, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to MOST_WORDS words that occur `least` times, as (lang, phrase, n_words, f),
    and the number of words of each language, as (lang, n)."""
    buckets = buckets_for(docs)
    whole = blocks(docs, lang_col, text_col, buckets)
    sizes = stored(_words_of(whole), "sizes")

    def cut(made: DataFrame, lengths: tuple[int, ...], how) -> DataFrame:
        found, read = survivors_by_block(made, lengths, least, buckets)
        cut_down = made.join(found, "block_id").mapInArrow(how, _BLOCK_DDL)
        left = stored_in_buckets(cut_down, "phrase-blocks", "block_id", buckets)
        discard(*read)
        return left

    by_words = cut(whole, (1,), _cut_to_words)
    discard(whole)
    words = stored(counted(by_words, (1,), least), "phrases")
    by_pairs = cut(by_words, (2,), _cut_to_pairs)
    discard(by_words)
    longer = tuple(range(3, MOST_WORDS + 1))
    found, read = survivors_by_block(by_pairs, longer, least, buckets)
    chosen = by_pairs.join(found, "block_id")
    frequent = stored(
        words.union(counted(by_pairs, (2,), least)).union(counted(chosen, longer, least, chosen=True)),
        "phrases",
    )
    discard(by_pairs, words, *read)
    return frequent, sizes


# --- scores --------------------------------------------------------------------------------


def _slice(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("_words", first, n), " ")


def scored_phrases(frequent: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more, by the worst cut."""
    split = frequent.where("n_words > 1").withColumn("_words", F.split("phrase", " "))
    cuts = split.select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("n_words") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    _slice(F.lit(1), k).alias("head"),
                    _slice(k + 1, F.col("n_words") - k).alias("tail"),
                ),
            )
        ).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    parts = frequent.select("lang", "phrase", "f")
    heads = parts.withColumnsRenamed({"phrase": "head", "f": "l"})
    tails = parts.withColumnsRenamed({"phrase": "tail", "f": "r"})
    # Counts are below 10**15, so both products and their quotient are exact.
    score = F.expr(
        "(CAST(a AS DECIMAL(15, 0)) * CAST(1000 * n AS DECIMAL(19, 0)))"
        " div (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))"
    )
    whole = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .join(sizes, "lang")
        .withColumn("score", score.cast("long"))
    )
    worst = whole.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")
    )
    return worst.select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")


def without_parts(scored: DataFrame, frequent: DataFrame) -> DataFrame:
    """`scored` without the phrases that stand in a longer one as often as at all."""
    longer = frequent.where("n_words > 2").withColumn("_words", F.split("phrase", " "))
    inner = longer.select(
        "lang",
        "f",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("n_words") - 1),
                    lambda m: F.transform(
                        F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: _slice(i, m)
                    ),
                )
            )
        ).alias("phrase"),
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    return (
        scored.join(most, ["lang", "phrase"], "left")
        .where("_longer IS NULL OR _longer < a")
        .drop("_longer")
    )


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    top: int = TOP,
) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words
    `[^\\x20\\x09]+`. A phrase has 2 to MOST_WORDS words of one piece, at least `least`
    occurrences (a, overlaps included), and the score floor(1000 * a * n / (l * r)) of its
    lowest cut, the first of equal ones; l and r count the parts, n the words of the language.
    Phrases inside a longer one that occurs as often are dropped. Ranked by score, a (both
    descending) and phrase (bytes). A null language is `und`. Null and empty texts have no
    word, repeated rows count again, and a text of any length is read as a whole. An empty
    table gives no row.
    """
    frequent, sizes = frequent_phrases(docs, lang_col, text_col, least)
    left = stored(without_parts(scored_phrases(frequent, sizes), frequent), "collocations")
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # The best of every part of a language first, so that no task sorts a whole language.
    dealt = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    of_part = dealt.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))
    ).where(F.col("_rank") <= top)
    ranked = of_part.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    ).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
