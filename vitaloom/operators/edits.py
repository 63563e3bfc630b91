"""Reviewer edits: a log of (artifact_id, path, value, seq) applied to profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.functions import rules
from vitaloom.functions.remember import remembered
from vitaloom.functions.rows import unfold
from vitaloom.functions.text import comma_items, is_blank, no_strings

SCALARS = tuple(f.name for f in S.PROFILE.fields if isinstance(f.dataType, T.StringType))
RECORD_LISTS = {
    name: tuple(
        f.name
        for f in S.PROFILE[name].dataType.elementType.fields
        if isinstance(f.dataType, T.StringType)
    )
    for name in ("languages", "work_experience", "education", "certifications")
}
# Position in a list as edits write it, and the paths of list items that a list can grow by.
INDEX = r"(?:0|[1-9]\d*)"
SKILL = rf"^skills\.{INDEX}\z"
BULLET = rf"^work_experience\.{INDEX}\.description\.{INDEX}\z"


def _newest(edits: DataFrame) -> DataFrame:
    """Newest value of every path, its first edit, and the last one that cleared it."""
    return (
        edits.withColumn("value", F.coalesce("value", F.lit("")))
        .groupBy("artifact_id", "path")
        .agg(
            F.max_by("value", "seq").alias("value"),
            F.min("seq").alias("first"),
            F.max(F.when(F.col("value") == "", F.col("seq"))).alias("cleared"),
        )
        .where("value <> ''")
    )


def buffered_edits(edits: DataFrame) -> DataFrame:
    """What the edit buffer holds in the end: (artifact_id, path, value, position).

    A path keeps the place of its first edit; an empty value removes it from the buffer,
    and a later edit enters it anew. One aggregate with map-side combination gives all paths;
    only those that were cleared and written again look at the log a second time.
    """
    newest = _newest(edits)
    keys = ["artifact_id", "path"]
    settled = newest.where("cleared IS NULL").select(*keys, "value", F.col("first").alias("position"))
    anew = (
        newest.where("cleared IS NOT NULL")
        .select(*keys, "value", "cleared")
        .join(edits.select(*keys, "seq").hint("merge"), keys)
        .where("seq > cleared")
        .groupBy(*keys)
        .agg(F.max("value").alias("value"), F.min("seq").alias("position"))
    )
    return settled.unionByName(anew)


def _part(path: Column, i: int) -> Column:
    return F.get(F.split(path, r"\."), i)


def _index(path: Column, i: int) -> Column:
    """A list position of any length; null where it is no number or past all lists."""
    return _part(path, i).try_cast("bigint")


def addressed(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Buffered edits with `applies`: whether the path names a place in that profile.

    The path of a list item that a list may grow by has `grows`, the list's name: whether it
    applies depends on the list in force when its turn comes. The profile side is one narrow
    row per artifact (lists and their sizes), not the profile itself.
    """
    p = F.col("profile")
    shape = profiles.select(
        "artifact_id",
        F.map_filter(
            p["client_display_rules"], lambda _, rule: rule == C.PENDING_CONFIRMATION
        ).alias("_pending"),
        p["skills"].alias("_skills"),
        F.transform(p["work_experience"], lambda x: x["description"]).alias("_bullets"),
        *[F.size(p[name]).alias(f"_{name}") for name in RECORD_LISTS],
    )
    path = F.col("path")
    index = _index(path, 1)
    applies = path.isin(*SCALARS)
    applies = applies | ((path == "current_title") & (F.col("_work_experience") > 0))
    for name, leaves in RECORD_LISTS.items():
        pattern = rf"^{name}\.{INDEX}\.({'|'.join(leaves)})\z"
        applies = applies | (F.rlike(path, F.lit(pattern)) & (index < F.col(f"_{name}")))
    bullet = F.rlike(path, F.lit(BULLET)) & (index < F.col("_work_experience"))
    grows = F.when((path == "skills") | F.rlike(path, F.lit(SKILL)), F.lit("skills")).when(
        bullet, F.lit("bullets")
    )
    # A shape's lists and maps are many times their compressed files, by which Spark would
    # broadcast them.
    return buffered_edits(edits).join(shape.hint("merge"), "artifact_id").select(
        "artifact_id",
        "path",
        "value",
        "position",
        F.coalesce(applies, F.lit(False)).alias("applies"),
        grows.alias("grows"),
        F.when(
            (path != "current_title") & F.map_contains_key("_pending", _part(path, 0)),
            _part(path, 0),
        ).alias("settled_rule"),
        "_skills",
        "_bullets",
    )


def _entry(i: int) -> Column:
    index = F.when(F.col("path") == "skills", F.lit(-1)).otherwise(_index(F.col("path"), i))
    return F.struct(
        F.col("position").cast("bigint").alias("position"),
        index.cast("bigint").alias("index"),
        "value",
        "path",
    )


def _collected() -> list[Column]:
    """An artifact's edits of list items, and of single bullets with their record."""
    skill = F.when(F.col("grows") == "skills", _entry(1))
    bullet = F.when(
        F.col("grows") == "bullets",
        F.struct(_index(F.col("path"), 1).alias("record"), _entry(3).alias("entry")),
    )
    return [
        F.collect_list(skill).alias("_skill_edits"),
        F.collect_list(bullet).alias("_bullet_edits"),
    ]


def _in_turn(items: Column, entries: Column) -> Column:
    """(items, lost): a list after its edits in the order of their positions.

    An item is replaced, a position at the end of the list makes it longer, -1 replaces the
    whole list by the parts of a text. Entries past the end change nothing; their paths are
    `lost`.
    """
    start = F.struct(F.coalesce(items, no_strings()).alias("items"), no_strings().alias("lost"))

    def edit(state: Column, e: Column) -> Column:
        held, size = state["items"], F.size(state["items"]).cast("bigint")
        put = F.transform(
            held, lambda x, i: F.when(i.cast("bigint") == e["index"], e["value"]).otherwise(x)
        )
        parts = comma_items(F.replace(e["value"], F.lit("\n"), F.lit(",")))
        fits = e["index"].between(-1, size)
        now = (
            F.when(e["index"] == -1, parts)
            .when(e["index"] == size, F.array_append(held, e["value"]))
            .when(fits, put)
            .otherwise(held)
        )
        lost = F.when(fits, state["lost"]).otherwise(F.array_append(state["lost"], e["path"]))
        return F.struct(now.alias("items"), lost.alias("lost"))

    return F.aggregate(F.sort_array(entries), start, edit)


def _of_record(edits: Column, i: Column) -> Column:
    mine = F.filter(edits, lambda e: e["record"] == i.cast("bigint"))
    return F.transform(mine, lambda e: e["entry"])


def unapplied_edits(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Buffered edits whose path names nothing in the profile when its turn comes.

    Together with those that apply they are all the edits of the buffer.
    """
    found = addressed(profiles, edits)
    columns = ["artifact_id", "path", "value", "position"]
    nowhere = found.where(~F.col("applies") & F.col("grows").isNull()).select(*columns)
    in_lists = (
        found.where(F.col("grows").isNotNull())
        .groupBy("artifact_id")
        .agg(
            *_collected(),
            F.any_value("_skills").alias("_skills"),
            F.any_value("_bullets").alias("_bullets"),
        )
    )
    bullets = F.flatten(
        F.transform(
            F.coalesce("_bullets", F.array().cast("array<array<string>>")),
            lambda items, i: _in_turn(items, _of_record(F.col("_bullet_edits"), i))["lost"],
        )
    )
    lost = F.concat(_in_turn(F.col("_skills"), F.col("_skill_edits"))["lost"], bullets)
    every = F.concat(
        "_skill_edits", F.transform("_bullet_edits", lambda e: e["entry"])
    )
    past = in_lists.select(
        "artifact_id", F.explode(every).alias("e"), lost.alias("lost")
    ).where(F.array_contains("lost", F.col("e.path")))
    return nowhere.unionByName(
        past.select("artifact_id", "e.path", "e.value", F.col("e.position").alias("position"))
    )


def apply_edits(profiles: DataFrame, edits: DataFrame, buckets: int | None = None) -> DataFrame:
    """Edited profiles; the profiles given stay as they are.

    For profiles stored in `buckets` by artifact the log is dealt alike before it is reduced, so
    that the profiles need no exchange.

    Collected per artifact are edits that name a place in its profile, one each, pending
    rules it has, and edits of items of its lists of text, one for each item named.
    """
    if buckets is not None:
        edits = edits.repartition(buckets, "artifact_id")
    found = (
        addressed(profiles, edits)
        .where(F.col("applies") | F.col("grows").isNotNull() | F.col("settled_rule").isNotNull())
        .groupBy("artifact_id")
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.when(
                        F.col("applies"),
                        F.struct("path", F.struct("value", "position").alias("edit")),
                    )
                )
            ).alias("_edits"),
            *_collected(),
            F.collect_set("settled_rule").alias("_settled"),
        )
    )
    if buckets is not None:
        found = found.repartition(buckets, "artifact_id")
    return (
        profiles.join(found, "artifact_id", "left")
        .withColumn(
            "profile",
            F.when(
                F.col("_settled").isNotNull(),
                _edited(),
            ).otherwise(F.col("profile")),
        )
        .drop("_edits", "_settled", "_skill_edits", "_bullet_edits")
    )


def _edit(edits: Column, path: Column | str) -> Column:
    return F.try_element_at(edits, path if isinstance(path, Column) else F.lit(path))


@remembered
def _edited() -> Column:
    profile, edits, settled = F.col("profile"), F.col("_edits"), F.col("_settled")
    out = profile
    for name in SCALARS:
        out = out.withField(name, F.coalesce(_edit(edits, name)["value"], profile[name]))
    out = out.withField(
        "skills", _in_turn(profile["skills"], F.col("_skill_edits"))["items"]
    )
    for name, leaves in RECORD_LISTS.items():
        out = out.withField(name, _records(profile[name], name, leaves, edits))
    return out.withField(
        "client_display_rules",
        F.map_filter(
            F.coalesce(profile["client_display_rules"], rules.no_rules()),
            lambda name, _: ~F.array_contains(settled, name),
        ),
    )


def _records(records: Column, name: str, leaves: tuple[str, ...], edits: Column) -> Column:
    def leaf(record: Column, i: Column, leaf_name: str) -> Column:
        path = F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(f".{leaf_name}"))
        own = _edit(edits, path)
        if (name, leaf_name) == ("work_experience", "title"):
            # `current_title` is another name of the first title; the later entry wins.
            alias = F.when(i == 0, _edit(edits, "current_title"))
            own = F.when(
                own.isNull() | (alias["position"] > own["position"]), F.coalesce(alias, own)
            ).otherwise(own)
        return F.coalesce(own["value"], record[leaf_name]).alias(leaf_name)

    def bullets(record: Column, i: Column) -> Column:
        own = _of_record(F.col("_bullet_edits"), i)
        changed = _in_turn(record["description"], own)["items"]
        return F.when(F.size(own) > 0, changed).otherwise(record["description"]).alias("description")

    def record(value: Column, i: Column) -> Column:
        fields = [leaf(value, i, leaf_name) for leaf_name in leaves]
        if name == "work_experience":
            fields.append(bullets(value, i))
        return F.struct(*fields)

    return F.transform(records, record)


def remaining_missing(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """(artifact_id, field_name, label) of missing fields without a non-blank edit."""
    filled = _newest(edits.where(F.col("path").isin(*C.REQUIRED_FIELDS))).where(
        ~is_blank(F.col("value"))
    )
    open_fields = unfold(profiles, "profile.missing_fields", "artifact_id").select(
        "artifact_id", "item.field_name", "item.label"
    )
    return open_fields.join(
        filled.select("artifact_id", F.col("path").alias("field_name")),
        ["artifact_id", "field_name"],
        "left_anti",
    )


def export_gate(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Per artifact the number of open missing fields; any left asks for confirmation."""
    counts = (
        remaining_missing(profiles, edits)
        .groupBy("artifact_id")
        .agg(F.count(F.lit(1)).alias("_open"))
    )
    remaining = F.coalesce(F.col("_open"), F.lit(0)).cast("long")
    return profiles.select("artifact_id").join(counts, "artifact_id", "left").select(
        "artifact_id",
        remaining.alias("remaining"),
        (remaining > 0).alias("needs_confirmation"),
    )
