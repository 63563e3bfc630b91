"""Artifact state as a stored table that batches of events are merged into.

Artifacts are dealt to a fixed number of buckets by a hash of their id. A merge reads and
rewrites only the buckets its events touch, into a folder of its own; a manifest that names the
folder of each bucket then makes all of them visible at once. Nothing that a manifest names is
ever changed, so readers keep the snapshot they started with, and a merge that dies before its
manifest leaves the table as it was. Lookups read one bucket.

A manifest also holds the newest batch of every stream that was merged. A batch that comes
again is passed over; that merging is idempotent by itself covers batches without a number.
Two merges at a time: the manifest is created, never replaced, so one of them finds its number
taken and merges again on what the other wrote.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.operators import artifacts
from vitaloom.operators.validate import is_safe_artifact_id

BUCKETS = 64
ATTEMPTS = 20


@dataclass(frozen=True)
class Manifest:
    """A snapshot: where each bucket lies, and the newest batch of each stream in it."""

    number: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def as_json(self) -> str:
        return json.dumps(
            {
                "number": self.number,
                "buckets": self.buckets,
                "folders": {str(b): f for b, f in sorted(self.folders.items())},
                "batches": self.batches,
            }
        )

    @staticmethod
    def from_json(text: str) -> Manifest:
        made = json.loads(text)
        folders = {int(b): f for b, f in made["folders"].items()}
        return Manifest(made["number"], made["buckets"], folders, made["batches"])


class Taken(Exception):
    """Another merge has written the manifest of this number."""


class JobTable:
    """The stored table of artifact jobs under `folder`, which all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._buckets = buckets

    # --- manifests ---------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        files, folder = self._files(), self._path("manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> Manifest | None:
        """The manifest, or none for one that a writer died over."""
        path = self._path("manifests", f"{number:012d}.json")
        text = "\n".join(
            r.value for r in self.spark.read.text(path.toString(), wholetext=True).collect()
        )
        try:
            return Manifest.from_json(text)
        except ValueError:
            return None

    def manifest(self) -> Manifest:
        """The newest snapshot; an empty one before the first merge."""
        for number in reversed(self._numbers()):
            if found := self._read(number):
                return found
        return Manifest(-1, self._buckets)

    def _commit(self, manifest: Manifest) -> None:
        path = self._path("manifests", f"{manifest.number:012d}.json")
        try:
            out = self._files().create(path, False)
        except Py4JJavaError as problem:
            if "AlreadyExists" not in str(problem.java_exception):
                raise
            raise Taken(manifest.number) from problem
        out.write(manifest.as_json().encode())
        out.close()

    # --- merging -----------------------------------------------------------------------

    def merge(self, events: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Merges a batch of events; false if this stream's batch is in the table already.

        The events are read once. A hot artifact reaches the shuffle as one row a task.
        """
        if stream is not None and self._has(self.manifest(), stream, batch):
            return False
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        parts = artifacts.partial_state(events.where(F.col("artifact_id").isNotNull()))
        parts.withColumn("bucket", self._bucket(F.col("artifact_id"))).write.parquet(staged)
        new = self.spark.read.schema(self._schema).parquet(staged)
        # At most as many numbers as there are buckets.
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        try:
            for _ in range(ATTEMPTS):
                # The number is settled before the base is read: what another merge commits
                # from here on takes this number.
                number = max(self._numbers(), default=-1) + 1
                base = self.manifest()
                if stream is not None and self._has(base, stream, batch):
                    return False
                folders = dict(base.folders)
                if touched:
                    folder = self._rewrite(base, new, touched)
                    folders.update((bucket, folder) for bucket in touched)
                batches = {**base.batches, **({} if stream is None else {stream: batch})}
                try:
                    self._commit(replace(base, number=number, folders=folders, batches=batches))
                    return True
                except Taken:
                    continue
            raise RuntimeError(f"no manifest could be written in {ATTEMPTS} attempts")
        finally:
            self._files().delete(self._path("staged", staged.rpartition("/")[2]), True)

    @staticmethod
    def _has(manifest: Manifest, stream: str, batch: int) -> bool:
        return manifest.batches.get(stream, -1) >= batch

    def _bucket(self, artifact_id):
        buckets = self.manifest().buckets
        return F.pmod(F.xxhash64(artifact_id), F.lit(buckets)).cast("int")

    def _rewrite(self, base: Manifest, new: DataFrame, touched: list[int]) -> str:
        """A folder with the touched buckets, old and new parts merged."""
        old = self._parts(base, touched).withColumn(
            "bucket", F.pmod(F.xxhash64("artifact_id"), F.lit(base.buckets)).cast("int")
        )
        # One exchange: grouping by bucket, artifact and name is met by buckets as they are.
        both = old.unionByName(new).repartition("bucket")
        name = uuid.uuid4().hex
        artifacts.merged_state(both, "bucket").write.partitionBy("bucket").parquet(
            f"{self.folder}/data/{name}"
        )
        return name

    def expire(self, keep: int = 10) -> int:
        """Drops all but the newest `keep` snapshots and the folders only they named."""
        numbers = self._numbers()
        kept = {f for n in numbers[-keep:] if (m := self._read(n)) for f in m.folders.values()}
        old = {f for n in numbers[:-keep] if (m := self._read(n)) for f in m.folders.values()}
        for folder in old - kept:
            self._files().delete(self._path("data", folder), True)
        for number in numbers[:-keep]:
            self._files().delete(self._path("manifests", f"{number:012d}.json"), False)
        return len(old - kept)

    # --- reading -----------------------------------------------------------------------

    @cached_property
    def _schema(self) -> T.StructType:
        empty = self.spark.createDataFrame([], S.ARTIFACT_EVENT)
        schema = artifacts.partial_state(empty).schema
        fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
        return T.StructType([*fields, T.StructField("bucket", T.IntegerType())])

    def _parts(self, manifest: Manifest, buckets: list[int]) -> DataFrame:
        schema = T.StructType(self._schema.fields[:-1])
        paths = [
            f"{self.folder}/data/{manifest.folders[b]}/bucket={b}" for b in buckets if b in manifest.folders
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def parts(self) -> DataFrame:
        """Merged parts of all artifacts, of the newest snapshot."""
        manifest = self.manifest()
        return self._parts(manifest, sorted(manifest.folders))

    def records(self) -> DataFrame:
        """`artifact_state` with `debug_artifacts`, one row per artifact."""
        return _records(self.parts())

    def lookup(self, artifact_id: str) -> DataFrame:
        """The artifact's record, or none; reads its bucket only. An unsafe id finds nothing."""
        manifest = self.manifest()
        bucket, safe = self.spark.range(1).select(
            self._bucket(F.lit(artifact_id)), is_safe_artifact_id(F.lit(artifact_id))
        ).first()
        own = self._parts(manifest, [bucket] if safe else [])
        return _records(own.where(F.col("artifact_id") == artifact_id))

    def recent(self, limit: int = C.LIST_DEFAULT) -> DataFrame:
        """The records of the most recently updated artifacts."""
        parts = self.parts()
        newest = artifacts.recent(artifacts.state_of(parts), limit)
        files = artifacts.debug_entries_of(
            parts.join(newest.select("artifact_id"), "artifact_id", "left_semi")
        )
        return _with_files(newest, artifacts.debug_maps(files))


def _records(parts: DataFrame) -> DataFrame:
    return _with_files(
        artifacts.state_of(parts), artifacts.debug_maps(artifacts.debug_entries_of(parts))
    )


def _with_files(records: DataFrame, maps: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return records.join(maps, "artifact_id", "left").withColumn(
        "debug_artifacts", F.coalesce("debug_artifacts", empty)
    )
