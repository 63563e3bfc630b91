"""Artifact state kept up to date from a stream of events.

The batch aggregation runs as a streaming aggregation: its state store holds the newest
values per artifact, and each micro-batch emits the rows it changed. They are written as
versions of a change log, one folder per micro-batch, so that a replayed batch overwrites
itself. The current state is the newest version of each artifact.

`start_job_sink` keeps no state of its own: each micro-batch is merged into the stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaloom import schemas as S
from vitaloom.operators import artifacts
from vitaloom.session import checkpoint_for
from vitaloom.sources.jobs import JobTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(S.ARTIFACT_EVENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on executor disks: it grows with the number of artifacts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _start(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={version}")

    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_state_sink(
    events: DataFrame, folder: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Change log of `artifact_state`."""
    where = checkpoint or checkpoint_for(events.sparkSession, "artifact-state", folder)
    return _start(artifacts.artifact_state(events), folder, where)


def start_debug_sink(
    events: DataFrame, folder: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Change log of `debug_entries`, one row per artifact and file role."""
    where = checkpoint or checkpoint_for(events.sparkSession, "debug-entries", folder)
    return _start(artifacts.debug_entries(events), folder, where)


def start_job_sink(
    events: DataFrame, table: JobTable, checkpoint: str | None = None
) -> StreamingQuery:
    """Merges every micro-batch into the stored job table, each exactly once.

    A batch that was committed to the table before the stream noted it comes again after a
    restart and is passed over by its number; the table alone holds the state.
    """
    where = checkpoint or checkpoint_for(events.sparkSession, "job-table", table.folder)

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, stream=where, batch=number)

    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", where)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Newest version of each key in a change log."""
    log = spark.read.parquet(folder)
    values = [c for c in log.columns if c not in (*keys, "version")]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "version").alias("_newest"))
        .select(*keys, *[F.col(f"_newest.{v}").alias(v) for v in values])
    )


def compact(spark: SparkSession, folder: str, target: str, *keys: str) -> None:
    """Write the current rows as a new log with one version, which later ones may follow."""
    newest = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    current(spark, folder, *keys).write.mode("overwrite").parquet(f"{target}/version={newest}")
