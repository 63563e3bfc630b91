"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, items: str, *keep: str) -> DataFrame:
    """(keep..., pos, item): one row per element, none for an empty or null array.

    A plain `posexplode` lets Catalyst infer a filter on the array and push it below the
    projections that compute the array, which would compute it twice. The outer form plus
    a filter on its position gives the same rows without that.
    """
    rows = df.select(*[F.col(k) for k in keep], F.posexplode_outer(items).alias("pos", "item"))
    return rows.where(F.col("pos").isNotNull()).withColumn("pos", F.col("pos").cast("long"))


def keep_where(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose boolean column holds, filtered where they stand.

    Pushed below the projection of a large expression, a plain filter would compute that
    expression a second time, and inline it at every reference.
    """
    others = [c for c in df.columns if c != flag]
    whole = F.when(F.col(flag), F.array(F.struct(*others)))
    rows = df.select(F.explode_outer(whole).alias("row"))
    return rows.where(F.col("row").isNotNull()).select("row.*")
