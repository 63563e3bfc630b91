"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Index: one posting (term_id, row_id, pos) for every occurrence of a test term in the training
texts, and under the term of no letters one posting a text, whose place is its number of
words. A shard of the index holds the postings of the texts one task has read, clustered by
term, so that looking a term up skips the rest of a shard. Building it shuffles nothing, and
no term, however common, meets in one task.

Search: the terms of every test window are ranked by the number of their postings. The list
of the rarest gives candidate places; the lists of the others, each moved by its offset, are
intersected with them in the order of that rank: first the next rarest two, which leave
little, then the rest. With `slack`, a term may stand that many words from its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaloom.llm.common import stored

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Ranks that are intersected before the rest.
RARE = 3
_LENGTH_TERM = ""


def words_of(text: Column) -> Column:
    """Words of a whole text in order, A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window_id, terms) of all distinct windows; (item_id, window_id) of their items.

    A window is WINDOW consecutive words; an item of fewer words is one window, one of no
    words has none. Items without an id have no windows. Rows that repeat an id add up.
    """
    runs = (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w"))
        .where("size(w) > 0")
        .select(
            "item_id",
            "w",
            F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))).alias("s"),
        )
        .select("item_id", F.slice("w", F.col("s") + 1, WINDOW).alias("terms"))
        .distinct()
    )
    owned = stored(runs, "item-windows")
    distinct = stored(
        owned.select("terms").distinct().withColumn("window_id", F.monotonically_increasing_id()),
        "windows",
    )
    return distinct, stored(owned.join(distinct, "terms").select("item_id", "window_id"), "owners")


def vocabulary(distinct: DataFrame) -> DataFrame:
    """(term, term_id): every term of the windows; id 0 is the term of text lengths."""
    spark = distinct.sparkSession
    terms = distinct.select(F.explode("terms").alias("term")).distinct()
    numbered = terms.withColumn("term_id", F.monotonically_increasing_id() + 1)
    length = spark.range(1).select(
        F.lit(_LENGTH_TERM).alias("term"), F.lit(0).cast("long").alias("term_id")
    )
    return stored(numbered.union(length), "vocabulary")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term_id, row_id, pos, doc_id) stored in the shared folder; see the module's text.

    `terms` is a vocabulary; Spark broadcasts it while its stored size is below Spark's own
    limit. row_id tells rows apart that repeat a doc_id; doc_id stands with lengths only.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.concat(words_of(F.col(text_col)), F.array(F.lit(_LENGTH_TERM))).alias("words"),
    )
    postings = rows.select("row_id", "doc_id", F.posexplode("words").alias("pos", "term"))
    known = postings.join(terms, "term").select(
        "term_id",
        "row_id",
        "pos",
        F.when(F.col("term_id") == 0, F.col("doc_id")).alias("doc_id"),
    )
    return stored(known.sortWithinPartitions("term_id"), "index")


def ranked_terms(distinct: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(window_id, off, term_id, n_terms, rank): terms by rarity, of windows that can occur."""
    counts = index.groupBy("term_id").agg(F.count("*").alias("n_postings"))
    placed = (
        distinct.select("window_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("off", "term"))
        .join(terms, "term")
        .join(counts, "term_id")
    )
    of_window = Window.partitionBy("window_id")
    return stored(
        placed.select(
            "window_id",
            "off",
            "term_id",
            "n_terms",
            F.count("*").over(of_window).alias("found"),
            F.row_number().over(of_window.orderBy("n_postings", "off")).alias("rank"),
        )
        .where("found = n_terms")
        .drop("found"),
        "ranked",
    )


def matches(index: DataFrame, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """(window_id, row_id, start, n_terms): where windows occur, start being the place of the
    first term by the anchor's place.

    slack 0 gives exact phrases. Otherwise each other term may stand up to `slack` words from
    its place, which gives proximity matches; the anchor is the window's rarest term.
    """
    anchors = ranked.where("rank = 1").select("window_id", "off", "term_id", "n_terms")
    found = (
        index.where("term_id > 0")
        .join(anchors, "term_id")
        .select("window_id", "row_id", (F.col("pos") - F.col("off")).alias("start"), "n_terms")
    )
    if slack == 0:
        found = found.where("start >= 0")
    for ranks in (F.col("rank").between(2, RARE), F.col("rank") > RARE):
        found = stored(_intersect(stored(found, "places"), index, ranked.where(ranks), slack), "places")
    return found


def _intersect(found: DataFrame, index: DataFrame, others: DataFrame, slack: int) -> DataFrame:
    """The places in `found` where all terms of `others` stand, too."""
    needed = stored(others.select("term_id").distinct(), "terms")
    wanted = found.join(others.select("window_id", "off", "term_id"), "window_id", "left")
    alone = wanted.where("term_id IS NULL").select(*found.columns)
    shifts = F.explode(F.sequence(F.lit(-slack), F.lit(slack)))
    places = wanted.where("term_id IS NOT NULL").select(
        *found.columns, "off", "term_id", shifts.alias("shift")
    )
    keyed = places.withColumn("pos", F.col("start") + F.col("off") + F.col("shift"))
    lists = index.join(needed, "term_id", "left_semi").select("term_id", "row_id", "pos")
    n_needed = others.groupBy("window_id").agg(F.count("*").alias("n_needed"))
    # The places are few beside the postings: hash them rather than sort the postings.
    met = (
        lists.join(keyed.hint("shuffle_hash"), ["row_id", "term_id", "pos"])
        .groupBy(*found.columns)
        .agg(F.count_distinct("off").alias("n_met") if slack else F.count("*").alias("n_met"))
    )
    return met.join(n_needed, "window_id").where("n_met = n_needed").select(*found.columns).union(alone)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of `docs`.

    A word is hit inside any occurrence of a window. A null or empty text has no words and no
    hits; rows that repeat an id, or have none, are returned one by one. Without items, or
    with items of no words, nothing is hit. Other columns of both tables are not read.
    """
    distinct, owners = windows(items, item_col, item_text_col)
    terms = vocabulary(distinct)
    index = build_index(docs, terms, id_col, text_col)
    hits = matches(index, ranked_terms(distinct, terms, index))
    words = (
        hits.groupBy("row_id", "start")
        .agg(F.max("n_terms").alias("n_terms"))
        .select("row_id", F.explode(F.expr("sequence(start, start + n_terms - 1)")).alias("pos"))
        .distinct()
        .groupBy("row_id")
        .agg(F.count("*").alias("n_hit"))
    )
    found_items = (
        hits.select("row_id", "window_id")
        .distinct()
        .join(owners, "window_id")
        .select("row_id", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    lengths = index.where("term_id = 0").select(
        "row_id", "doc_id", F.col("pos").cast("long").alias("n_words")
    )
    return (
        lengths.join(words, "row_id", "left")
        .join(found_items, "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias(
                "items_sha256"
            ),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
