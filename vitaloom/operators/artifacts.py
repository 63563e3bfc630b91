"""Artifact state from an event log: the newest value of each column per artifact.

Three writers share the log. Each supplies its own columns, and a supplied null counts as
a value. All aggregates are mergeable, so a map-side combine shrinks even an artifact that
holds a third of the log to one row per task before the shuffle. Events are ordered by
(ts, seq); a late event therefore never overwrites a newer one. The same functions run on
a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom.operators.validate import is_safe_artifact_id

PROCESSED = "processed"
TARGET_UPLOADED = "target_format_uploaded"
GENERATED = "generated"

# Columns by the events that write them; one aggregate serves each group.
WRITTEN_BY = {
    (PROCESSED,): (
        "source_filename",
        "source_file_type",
        "original_pdf_preview_url",
        "original_preview_error",
    ),
    (TARGET_UPLOADED,): (
        "target_format_role",
        "target_format_filename",
        "target_format_download_url",
    ),
    (GENERATED,): (
        "template_name",
        "blind_profile",
        "docx_download_url",
        "pdf_download_url",
        "pdf_preview_url",
    ),
    (PROCESSED, GENERATED): ("missing_field_labels",),
    (PROCESSED, TARGET_UPLOADED, GENERATED): ("event_type", "artifact_dir"),
}


def event_order() -> Column:
    return F.struct("ts", "seq")


def artifact_state(events: DataFrame) -> DataFrame:
    """One row per artifact; `created_at` from its first event, `updated_at` from its last."""
    aggregates = [F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")]
    for i, (writers, columns) in enumerate(WRITTEN_BY.items()):
        order = F.when(F.col("event_type").isin(*writers), event_order())
        # Rows of other writers have a null order, which max_by passes over.
        aggregates.append(F.max_by(F.struct(*columns), order).alias(f"_g{i}"))
    return _finished(events.groupBy("artifact_id").agg(*aggregates))


def _finished(state: DataFrame) -> DataFrame:
    """The columns of an artifact from its newest groups of values."""
    written = {
        column: F.col(f"_g{i}.{column}")
        for i, columns in enumerate(WRITTEN_BY.values())
        for column in columns
    }
    labels = written.pop("missing_field_labels")
    status = written.pop("event_type")
    return state.select(
        "artifact_id",
        "created_at",
        "updated_at",
        status.alias("status"),
        *[value.alias(name) for name, value in written.items()],
        # Null until a processing or a generation has counted.
        F.when(F.col("_g3").isNotNull(), F.size(labels)).alias("needs_review_count"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("missing_field_labels"),
    )


# --- state that merges with later state -----------------------------------------------------
# A part of an artifact: its columns (name is null), or one of its debug files. Values keep the
# order of the event they come from, so that parts of a log merge in any order, a part that is
# merged twice changes nothing, and what results is the state of the whole log.


def partial_state(events: DataFrame) -> DataFrame:
    """(artifact_id, name, created_at, updated_at, _g0, _g1, ..., file) of a part of the log."""
    files = F.transform(
        F.map_entries("debug_artifacts"),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("location")),
    )
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("location"))
    rows = events.select(
        "*", F.explode(F.concat(F.array(none), F.coalesce(files, F.slice(F.array(none), 1, 0)))).alias("_file")
    )
    own = F.col("_file.name").isNull()
    given = [F.when(own, F.col("ts")).alias("created_at"), F.when(own, F.col("ts")).alias("updated_at")]
    for i, (writers, columns) in enumerate(WRITTEN_BY.items()):
        value = F.struct("ts", "seq", *columns)
        given.append(F.when(own & F.col("event_type").isin(*writers), value).alias(f"_g{i}"))
    file = F.when(~own, F.struct("ts", "seq", "_file.location"))
    return merged_state(
        rows.select("artifact_id", F.col("_file.name").alias("name"), *given, file.alias("file"))
    )


def merged_state(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts of the same artifact and name as one; `keys` are further grouping columns."""
    groups = [*(f"_g{i}" for i in range(len(WRITTEN_BY))), "file"]
    newest = [
        F.max_by(g, F.when(F.col(g).isNotNull(), F.struct(f"{g}.ts", f"{g}.seq"))).alias(g)
        for g in groups
    ]
    return parts.groupBy(*keys, "artifact_id", "name").agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), *newest
    )


def state_of(parts: DataFrame) -> DataFrame:
    """`artifact_state` of merged parts."""
    return _finished(parts.where(F.col("name").isNull()))


def debug_entries_of(parts: DataFrame) -> DataFrame:
    """`debug_entries` of merged parts."""
    return parts.where(F.col("name").isNotNull()).select("artifact_id", "name", "file.location")


def debug_entries(events: DataFrame) -> DataFrame:
    """(artifact_id, name, location): the newest location per artifact and file role."""
    return (
        # The outer form keeps Catalyst from computing the map twice to skip empty ones.
        events.select(
            "artifact_id", event_order().alias("_order"), F.explode_outer("debug_artifacts")
        )
        .where(F.col("key").isNotNull())
        .groupBy("artifact_id", F.col("key").alias("name"))
        .agg(F.max_by("value", "_order").alias("location"))
    )


def debug_maps(entries: DataFrame) -> DataFrame:
    """One map per artifact, keys in order.

    The group of an artifact holds one row per file role, of which the writers know a
    fixed handful, however many events the artifact has.
    """
    return entries.groupBy("artifact_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("name", "location")))
        ).alias("debug_artifacts")
    )


def with_debug_artifacts(records: DataFrame, events: DataFrame) -> DataFrame:
    """Records with their `debug_artifacts`, an empty map where no event names a file.

    Only events of the given records are looked at: look up or list first.
    """
    own = events.join(records.select("artifact_id"), "artifact_id", "left_semi")
    maps = debug_maps(debug_entries(own))
    empty = F.create_map().cast("map<string,string>")
    return records.join(maps, "artifact_id", "left").withColumn(
        "debug_artifacts", F.coalesce("debug_artifacts", empty)
    )


def lookup(state: DataFrame, artifact_id: str) -> DataFrame:
    """The artifact's row, or none; an unsafe id finds nothing.

    The id is a grouping key of the state, so the filter reaches the scan of the log.
    """
    return state.where(
        (F.col("artifact_id") == artifact_id) & is_safe_artifact_id(F.lit(artifact_id))
    )


def recent(state: DataFrame, limit: int = C.LIST_DEFAULT) -> DataFrame:
    """The most recently updated artifacts; a top-k, not a sort of all."""
    bounded = max(1, min(limit, C.LIST_MAX))
    return state.orderBy(F.col("updated_at").desc(), F.col("artifact_id")).limit(bounded)


def first_written(events: DataFrame, *columns: str) -> DataFrame:
    """What each artifact's first event holds: originals are never overwritten."""
    return (
        events.groupBy("artifact_id")
        .agg(F.min_by(F.struct(*columns), event_order()).alias("_first"))
        .select("artifact_id", "_first.*")
    )


def not_yet_stored(incoming: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows whose key is not stored yet; of the stored side only keys are read."""
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def labels_to_json(labels: Column) -> Column:
    return F.to_json(labels)


def labels_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
