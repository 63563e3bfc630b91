"""Quality rules: plain statistics of each text, and robust multivariate outliers among them.

Everything is DataFrame operations. The statistics are computed inside the row of a text, so
no word ever leaves it. Texts that pass the plain rules are then judged within their language
and source by the minimum-covariance-determinant estimate of location and scatter: from a
start at medians and quartile ranges, concentration steps keep the SUBSET part of the group
that lies nearest by Mahalanobis distance and take mean and covariance of these rows anew. A
text is rejected when its squared distance exceeds the chi-square quantile OUTLIER.

Small groups lean on larger ones: the estimate of a group of n texts counts n / (n + SHRINK)
beside that of its language, and the language's beside that of all texts likewise. So verdicts
change smoothly with the size of a group, and the distance is always applied.

Groups meet only in partial aggregates: counts, means, covariances, and percentiles of values
rounded to a grid, whose buffers hold at most one number for each grid value. A group with a
third of all texts is a few rows a task at every shuffle. Estimates are one row a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import stored

MIN_WORDS = 50
# Share of repeated words, in hundredths, above which the plain rules fail.
MOST_REPEATED = 50
SUBSET = 0.75
STEPS = 4
OUTLIER = 0.9999
# As many texts as a group's own estimate needs to count half.
SHRINK = 50

_BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
# Statistic -> the scatter every group is granted, in squares added to the covariance. Most
# texts have no repeated line at all, and a single one must not lie infinitely far away. Each is
# so small that the statistic can reject by itself: in a group without any scatter of its own,
# a text goes when a sixth of its lines are duplicates, or a sixth of its words repeated.
GRANTED = {
    "log_words": 0.25,
    "log_word_chars": 0.1,
    "symbols": 0.06,
    "dup_lines": 0.08,
    "repeats": 0.08,
}
_NAMES = tuple(GRANTED)


def chi_square_cdf(x: float, k: int) -> float:
    """Probability that a chi-square value of k degrees of freedom is at most x."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, k) < p else (low, middle)
    return (low + high) / 2


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Words are `[^\\x20\\x09-\\x0D]+`; a null or empty text has none. A line counts when it
    holds a word; it is a duplicate when an earlier line equals it. A word is repeated when
    it stands in a window of three words that the text has twice or more. Windows are compared
    by 64-bit hashes within one text. Columns of `docs` with these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.withColumn("_text", text).withColumn(
        "_words",
        F.array_remove(F.split(F.translate("_text", _BLANKS, " " * len(_BLANKS)), " "), ""),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.sequence(F.lit(1), F.size("_words") - 2),
            lambda i: F.struct(
                F.xxhash64(
                    F.element_at("_words", i),
                    F.element_at("_words", i + 1),
                    F.element_at("_words", i + 2),
                ).alias("h"),
                i.alias("p"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    sorted_ = cut.withColumn("_lines", lines).withColumn("_windows", F.sort_array(windows))
    # Neighbours with one hash are the same window; both stand for three places each.
    same = F.zip_with(
        "_windows",
        F.slice("_windows", 2, F.greatest(F.size("_windows"), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
    )
    places = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
    counted = sorted_.withColumn("_places", places).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", " " + _BLANKS, "")).cast("long"),
            "n_symbols": (
                F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))
            ).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.size(
                F.array_distinct(
                    F.flatten(F.transform("_places", lambda p: F.array(p, p + 1, p + 2)))
                )
            ).cast("long"),
        }
    )
    return counted.drop("_text", "_words", "_lines", "_windows", "_places")


def base_failed() -> Column:
    """Too few words, or too many of them repeated."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    made = (
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return dict(zip(_NAMES, made))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(_NAMES)) for j in range(i + 1)]


_MOMENTS = [f"m_{i}" for i in range(len(_NAMES))] + [f"s_{i}_{j}" for i, j in _pairs()]
_FACTORS = [f"l_{i}_{j}" for i, j in _pairs()]


def _factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariance s_i_j to each row."""
    for i, j in _pairs():
        rest = F.col(f"s_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")
        estimates = estimates.withColumn(f"l_{i}_{j}", value)
    return stored(estimates.select("group", "n_group", *_MOMENTS, *_FACTORS), "estimates")


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with `distance`, the squared Mahalanobis distance from their group's centre."""
    joined = rows.join(estimates, "group")
    solved: list[Column] = []
    for i, name in enumerate(_NAMES):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return joined.withColumn("distance", sum((y * y for y in solved), F.lit(0.0))).select(
        *rows.columns, "n_group", "distance"
    )


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and a diagonal covariance from the quartiles."""
    quartiles = rows.groupBy("group").agg(
        F.count("*").alias("n_group"),
        *[
            F.percentile(F.round(name, 3), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q_{i}")
            for i, name in enumerate(_NAMES)
        ],
    )
    columns = {f"m_{i}": F.col(f"q_{i}")[1] for i in range(len(_NAMES))}
    for i, j in _pairs():
        spread = (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349
        granted = GRANTED[_NAMES[i]] ** 2
        columns[f"s_{i}_{j}"] = spread * spread + granted if i == j else F.lit(0.0)
    return _factor(quartiles.withColumns(columns))


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Mean and covariance of the nearest SUBSET part of each group."""
    size = len(_NAMES)
    inner = chi_square_quantile(SUBSET, size)
    # The nearest part scatters less than the whole; this factor makes up for it.
    widen = SUBSET / chi_square_cdf(inner, size + 2)
    far = _distances(rows, estimates).withColumn("far", F.round(F.log1p("distance"), 3))
    cuts = far.groupBy("group").agg(F.percentile("far", SUBSET).alias("cut"))
    near = far.join(cuts, "group").where("far <= cut")
    moments = near.groupBy("group").agg(
        F.max("n_group").alias("n_group"),
        *[F.avg(name).alias(f"m_{i}") for i, name in enumerate(_NAMES)],
        *[
            (
                F.covar_pop(_NAMES[i], _NAMES[j]) * widen
                + (GRANTED[_NAMES[i]] ** 2 if i == j else 0.0)
            ).alias(f"s_{i}_{j}")
            for i, j in _pairs()
        ],
    )
    return _factor(moments)


def _estimates(rows: DataFrame) -> DataFrame:
    """Location and scatter of every `group` of rows."""
    estimates = _start(rows)
    for _ in range(STEPS):
        estimates = _step(rows, estimates)
    return estimates.select("group", "n_group", *_MOMENTS)


def _leaning(own: DataFrame, wider: DataFrame, keys: str | None) -> DataFrame:
    """Estimates of `own` shrunk towards those of `wider`, which share `keys` or are one row.

    The scatter of a mixture of two groups: that of both, and that between their centres.
    """
    of = wider.select(
        *([F.col("group").alias(keys)] if keys else []), *[F.col(c).alias(f"w_{c}") for c in _MOMENTS]
    )
    # Without a key `wider` is one row.
    both = own.join(of, keys) if keys else own.crossJoin(F.broadcast(of))
    weight = F.col("n_group") / (F.col("n_group") + SHRINK)
    made = {f"m_{i}": weight * F.col(f"m_{i}") + (1 - weight) * F.col(f"w_m_{i}") for i in range(len(_NAMES))}
    apart = [F.col(f"m_{i}") - F.col(f"w_m_{i}") for i in range(len(_NAMES))]
    for i, j in _pairs():
        made[f"s_{i}_{j}"] = (
            weight * F.col(f"s_{i}_{j}")
            + (1 - weight) * F.col(f"w_s_{i}_{j}")
            + weight * (1 - weight) * apart[i] * apart[j]
        )
    kept = [c for c in own.columns if c not in made]
    return both.select(*kept, *[made[c].alias(c) for c in _MOMENTS])


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The statistics of every row of `docs`, base_failed, distance and kept.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance, kept. A null language or source is a group like others. Rows that fail the
    plain rules take no part in estimates, are not kept and have no distance. Groups of any size
    are judged; see the module's text for small ones. A text of any length is one row of numbers.
    Rows that repeat an id are judged one by one; an empty table gives an empty table.
    """
    lang = F.col(lang_col).cast("string").alias("l")
    named = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.to_json(F.struct(lang, F.col(source_col).cast("string").alias("s"))).alias("group"),
        F.to_json(F.struct(lang)).alias("of_lang"),
        F.lit("*").alias("of_all"),
    )
    base = stored(
        statistics(named).withColumn("base_failed", base_failed()).withColumns(_vector()).drop("text"),
        "statistics",
    )
    rows = base.where("NOT base_failed")
    own = _estimates(rows)
    of_lang = _estimates(rows.withColumn("group", F.col("of_lang")))
    # A stored column: joins on a literal may become cartesian products, which compute their rows anew
    # for every partition of the other side.
    of_all = _estimates(rows.withColumn("group", F.col("of_all")))
    langs = _leaning(of_lang, of_all, None)
    groups = own.join(rows.select("group", "of_lang").distinct(), "group")
    estimates = _factor(_leaning(groups, langs, "of_lang"))
    limit = chi_square_quantile(OUTLIER, len(_NAMES))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    verdicts = _distances(rows, estimates).select(
        *columns, "distance", (F.col("distance") <= limit).alias("kept")
    )
    failed = base.where("base_failed").select(
        *columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return verdicts.union(failed)
