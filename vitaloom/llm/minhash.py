"""Near-duplicate documents by circulant MinHash.

A text's set holds its distinct five-word shingles. Two permutations of a universe of
POSITIONS places make all signature coordinates: the first one scatters the shingles over
the universe, the second one, shifted circularly by k, gives coordinate k: the least value
its shifted form takes on the set. The shifted forms of one place stand next to each other
in memory, so a signature is a running minimum over rows of one table. After all coordinates
are there they are cut into bands; texts that agree on a band are candidates, and candidates
are linked when the Jaccard index of their full sets is at least the threshold.

Texts with equal sets are settled first, by grouping on a digest of the set with map-side
combination, so that copies never meet in pairs. Inside a band's bucket every member is
compared with one centre, which is linear in the bucket. Members of buckets that this leaves
in several components are then joined on their rarest shingles, across components only: a
filter that loses no link (see _pairs_across) and that does not pair texts which merely
share a common passage. So no link between candidates is lost, and members of a component
that stands are never paired.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import (
    WordHashes,
    batches_of,
    discard,
    mix,
    ngram_hashes,
    plain_words,
    stored,
    texts_of,
)

SHINGLE = 5
THRESHOLD = (75, 100)
COORDINATES = 128
ROWS_PER_BAND = 4
# Places of the permuted universe. Shingles that fall on one place can only make texts look
# more alike to the bands, which the exact check mends.
POSITIONS = 1 << 20
_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_digest", pa.binary()),
        ("rep", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)
_SIGNED_DDL = (
    "doc_id bigint, text_hash bigint, n_shingles bigint, set_digest binary, rep bigint,"
    " bands array<bigint>"
)


@cache
def _second_permutation() -> np.ndarray:
    """Row p holds the values at places p, p+1, ..., p+COORDINATES-1, around the circle."""
    order = np.argsort(mix(np.arange(POSITIONS, dtype=np.uint64))).astype(np.uint32)
    circle = np.concatenate([order, order[: COORDINATES - 1]])
    return np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    return np.unique(ngram_hashes(hashes.of(plain_words(text)), SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of one set that is not empty."""
    table = _second_permutation()
    places = (mix(shingles) & np.uint64(POSITIONS - 1)).astype(np.int64)
    least = table[places[:4096]].min(axis=0)
    for start in range(4096, len(places), 4096):
        np.minimum(least, table[places[start : start + 4096]].min(axis=0), out=least)
    return least


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, which also depends on the band's number."""
    rows = coordinates.astype(np.uint64).reshape(-1, ROWS_PER_BAND)
    keys = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS_PER_BAND):
        keys = mix(keys) ^ rows[:, i]
    return mix(keys).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def rows():
        for batch in batches:
            ids = (batch.column(i).to_pylist() for i in range(2))
            for doc_id, text_hash, text in zip(*ids, texts_of(batch.column(2))):
                shingles = shingle_set(text, hashes)
                if not len(shingles):
                    yield doc_id, text_hash, 0, None, None, None
                    continue
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                rep = int.from_bytes(digest[:8], "little", signed=True)
                yield doc_id, text_hash, len(shingles), digest, rep, bands(signature(shingles))

    yield from batches_of(rows(), _SIGNED)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_digest, rep and band keys of every document.

    `rep` is the number of the set in all that follows; documents come in at the end only.
    """
    return _narrow(docs, id_col, text_col).mapInArrow(_sign, _SIGNED_DDL)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )


def _sizes_allow(one: str, other: str) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    least, whole = THRESHOLD
    return (F.col(one) * whole >= F.col(other) * least) & (F.col(other) * whole >= F.col(one) * least)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with both texts -> (a, b) whose full sets are alike enough."""
    hashes, sets = WordHashes(), {}
    least, whole = THRESHOLD

    def set_of(doc_id, text):
        if doc_id not in sets:
            if len(sets) >= 64:
                sets.clear()
            sets[doc_id] = shingle_set(text, hashes)
        return sets[doc_id]

    for batch in batches:
        kept: tuple[list, list] = ([], [])
        rows = zip(
            batch.column(0).to_pylist(),
            batch.column(1).to_pylist(),
            texts_of(batch.column(2)),
            texts_of(batch.column(3)),
        )
        for a, b, text_a, text_b in rows:
            one, other = set_of(a, text_a), set_of(b, text_b)
            both = len(np.intersect1d(one, other, assume_unique=True))
            if whole * both >= least * (len(one) + len(other) - both):
                kept[0].append(a)
                kept[1].append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in kept], names=["a", "b"]
        )


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    of_a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    whole = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b")
    return whole.mapInArrow(_verify, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component), stored, of every node of the links (a, b): the least id it reaches.

    Least labels travel along the links, and each round every label is also replaced by its
    own label, so the number of rounds grows with the logarithm of the longest chain. Each
    round is written to the shared folder; the driver sees one number of it.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(around, "id").select(
            "id", F.col("component").alias("before"), F.least("component", "near").alias("now")
        )
        jumps = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        after = stored(
            spread.join(jumps, "now", "left").select(
                "id", "before", F.least("now", "further").alias("component")
            ),
            "labels",
        )
        discard(labels)
        if after.where("component <> before").isEmpty():
            discard(both)
            return after
        labels = after


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for rep, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            found = shingle_set(text, hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), rep, np.int64)), pa.array(found)],
                names=["rep", "shingle"],
            )


def _pairs_across(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in `apart` that may be links.

    Order all shingles by how many of these texts have them, rarest first. Two sets whose
    index reaches the threshold t share one of the first (1 - t) * n + 1 shingles of each,
    and behind the first they share enough must be left on either side to make up the
    intersection that t asks for. Shingles of one text only come first and match nothing, so
    a text with enough words of its own has no partner left, however many texts share its
    common passage.
    """
    least, whole = THRESHOLD
    rows = stored(
        texts.join(apart, "rep", "left_semi")
        .select("rep", "text")
        .mapInArrow(_shingle_rows, "rep bigint, shingle bigint"),
        "shingles",
    )
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n_texts")).where("n_texts > 1")
    ranked = rows.join(shared, "shingle").join(apart, "rep")
    of_text = Window.partitionBy("rep")
    n = F.col("n_shingles")
    own = n - F.count("*").over(of_text)
    prefix = stored(
        ranked.select(
            "*",
            (own + F.row_number().over(of_text.orderBy("n_texts", "shingle"))).alias("place"),
        )
        .where(F.col("place") <= n - F.ceil(n * least / whole) + 1)
        .select("shingle", "rep", "component", "n_shingles", (n - F.col("place")).alias("rest")),
        "prefixes",
    )
    pairs = stored(
        prefix.alias("x")
        .join(
            prefix.alias("y"),
            (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.rep") < F.col("y.rep"))
            & (F.col("x.component") != F.col("y.component"))
            & _sizes_allow("x.n_shingles", "y.n_shingles")
            & (
                (F.least("x.rest", "y.rest") + 1) * (least + whole)
                >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * least
            ),
        )
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct(),
        "pairs-across",
    )
    discard(rows, prefix)
    return pairs


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64) for every row of `docs`.

    A text of fewer than five words is one shingle of all its words. A null or empty text,
    or one of blanks, has no shingle, is linked with nothing and kept. A row without an id
    is its own component (null) and kept. Every row that repeats an id is judged by its own text;
    kept tells whether its id is the least of the component, so equal rows are kept together.
    A text of any length is compared as a whole. An empty table gives an empty table.
    """
    return (
        _judged(docs, id_col, text_col)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash")
    )


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and component, its number; two components can
    have one name where texts of one id lie in both."""
    rows = stored(signed(docs, id_col, text_col), "signed")
    # One row for each distinct set, and the least document that has it.
    reps = stored(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_digest")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("least"),
            F.first("rep").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "sets",
    )
    members = reps.select(
        "rep", "n_shingles", F.col("least.doc_id").alias("document"), F.explode("bands").alias("bucket")
    )
    # The centre of a bucket is its earliest document's set: of a family of copies that is most
    # often the same one in all buckets, so that few different pairs come up.
    centres = (
        members.groupBy("bucket")
        .agg(
            F.min(F.struct("document", "rep", "n_shingles")).alias("c"),
            F.min("rep").alias("low"),
            F.max("rep").alias("high"),
        )
        .where("low < high")
        .select("bucket", F.col("c.rep").alias("centre"), F.col("c.n_shingles").alias("n_centre"))
    )
    together = stored(
        members.join(centres, "bucket").select("bucket", "rep", "n_shingles", "centre", "n_centre"),
        "together",
    )
    # Sets whose sizes lie too far apart are no link, whatever they hold.
    stars = stored(
        together.where("centre <> rep")
        .where(_sizes_allow("n_centre", "n_shingles"))
        .select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
        .distinct(),
        "stars",
    )
    # Texts of all sets that share a bucket: any two of them may still be compared. Rows that
    # are equal throughout are grouped where the join has put them.
    met = together.select("rep").distinct().join(reps.select("rep", "least.*"), "rep")
    texts = stored(
        _narrow(docs, id_col, text_col)
        .join(met, ["doc_id", "text_hash"])
        .groupBy("doc_id", "text_hash", "rep")
        .agg(F.first("text").alias("text")),
        "texts",
    )
    links = stored(_linked(stars, texts), "links")
    first = components(links)

    # Members of a bucket that still hold several components, among those whose sizes allow
    # the threshold: sizes fall into classes that wide, and a member stands in its own class
    # and the next, so that any two that may be linked share one.
    least, whole = THRESHOLD
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(whole / least))
    labelled = stored(
        together.select("bucket", "rep", "n_shingles")
        .join(first.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select(
            "bucket",
            "rep",
            "n_shingles",
            F.coalesce("component", "rep").alias("component"),
            F.explode(F.array(size_class, size_class + 1)).alias("size_class"),
        ),
        "labelled",
    )
    split = (
        labelled.groupBy("bucket", "size_class")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("bucket", "size_class")
    )
    apart = stored(
        labelled.join(split, ["bucket", "size_class"])
        .select("rep", "component", "n_shingles")
        .distinct(),
        "apart",
    )
    discard(labelled, together, first)
    across = _pairs_across(apart, texts)
    more = stored(_linked(across.join(stars, ["a", "b"], "left_anti"), texts), "links")
    discard(stars, texts, apart, across)
    final = components(links.union(more))
    discard(links, more)

    of_set = reps.select("set_digest", "rep", F.col("least.doc_id").alias("least")).join(
        final.select(F.col("id").alias("rep"), "component"), "rep", "left"
    ).select("set_digest", "least", F.coalesce("component", "rep").alias("component"))
    smallest = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_set.join(smallest, "component").select("set_digest", "component_id", "component")
    return rows.select("doc_id", "n_shingles", "set_digest", "text_hash").join(
        named, "set_digest", "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias(
            "component_id"
        ),
        "text_hash",
        "component",
    )


def distinct_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` that stay when one of each component does: the least id and, where rows
    share it, the least text hash; of rows with one id and text, one. Rows without an id or
    without words all stay.
    """
    found = stored(_judged(docs, id_col, text_col), "components")
    judged = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    place = F.struct("doc_id", "text_hash")
    first = judged.groupBy("component").agg(F.min(place).alias("first"))
    gone = (
        judged.join(first, "component")
        .where(place != F.col("first"))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .distinct()
    )
    twice = (
        judged.groupBy("doc_id", "text_hash")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    )
    same = (docs[id_col].cast("long") == F.col("_id")) & (
        F.xxhash64(docs[text_col].cast("string")) == F.col("_hash")
    )
    own = [F.xxhash64(docs[text_col].cast("string")).alias("_hash_of_text"), docs[id_col].alias("_id_of_row")]
    single = (
        docs.join(twice.join(gone, ["_id", "_hash"], "left_anti"), same, "left_semi")
        .select(*[docs[c] for c in docs.columns], *own)
        .dropDuplicates(["_id_of_row", "_hash_of_text"])
        .select(*docs.columns)
    )
    return docs.join(gone.union(twice).distinct(), same, "left_anti").union(single)
