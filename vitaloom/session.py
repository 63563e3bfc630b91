"""Session settings this package relies on, and where it may write shared state."""

from __future__ import annotations

import hashlib
import tempfile
from functools import cache

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps carry no zone here; one fixed zone keeps casts the same everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Sizes of joins and shuffles are decided at run time from real sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide nested expressions are built from thousands of calls; recording the call site of
    # each takes longer than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Python tasks here get whole files and whole prompts; few rows fill a batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    # State of streams grows with the artifacts: on executor disks, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Repeated keys in a JSON payload: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("vitaloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may run without the setting; a cluster must name the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"vitaloom-{application}-")


def checkpoint_for(spark: SparkSession, purpose: str, output: str) -> str:
    """Checkpoint of the stream that serves one purpose and writes one output."""
    return f"{shared_folder(spark)}/{purpose}-{hashlib.sha256(output.encode()).hexdigest()}"
