"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from vitaloom.session import shared_folder

# Distinct words a worker remembers the hash of, before it starts anew.
REMEMBERED_WORDS = 300_000


def scratch(spark: SparkSession, purpose: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of `df`, computed once and kept as Parquet in the shared folder.

    Cuts the lineage: what reads the result survives the loss of any executor without
    computing `df` again.
    """
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


# Buckets of a stored table: as many as its source has partitions, between these; the upper one is
# Spark's own limit. A bucket may hold any number of rows.
LEAST_BUCKETS, MOST_BUCKETS = 32, 100_000


def buckets_for(df: DataFrame) -> int:
    return min(max(df.rdd.getNumPartitions(), LEAST_BUCKETS), MOST_BUCKETS)


def stored_in_buckets(df: DataFrame, purpose: str, key: str, buckets: int) -> DataFrame:
    """As `stored`, and joins on `key` bring the other side to this table's buckets, at any size."""
    spark, path = df.sparkSession, scratch(df.sparkSession, purpose)
    name = f"{purpose.replace('-', '_')}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet")
        .option("compression", "zstd")
        .bucketBy(buckets, key)
        .option("path", path)
        .saveAsTable(name)
    )
    kept = spark.table(name)
    kept.stored_at, kept.stored_as = path, name
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` and its like gave, when all that reads them has been stored itself."""
    for table in tables:
        spark = table.sparkSession
        if "stored_as" in vars(table):
            spark.sql(f"DROP TABLE IF EXISTS {table.stored_as}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; bytes.lower and bytes.split touch
    exactly those ASCII characters."""
    return text.lower().split() if text else []


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    values = values + _STEP
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; of the whole sequence if it is shorter."""
    n = min(n, len(words))
    if n == 0:
        return words
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) ^ words[i : len(words) - n + 1 + i]
    return mix(out ^ np.uint64(n))


def batches_of(
    rows: Iterable[tuple], schema: pa.Schema, size: int = 2000
) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def with_column(
    docs: DataFrame,
    value: Column,
    name: str,
    arrow: pa.DataType,
    ddl: str,
    make: Callable[[], Callable],
) -> DataFrame:
    """`docs` with the column `name`, in place of any such column, made of `value`.

    `make` runs once a task and gives the function from a value to a result. Rows go through
    in Arrow batches of bounded size; all other columns pass unchanged, without a shuffle.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    quoted = [f"`{c.replace('`', '``')}`" for c in kept]
    given = docs.select(*[docs[q] for q in quoted], value.alias("_value"))
    types = [f.dataType.simpleString() for f in given.schema][:-1]
    fields = ", ".join(f"{q} {t}" for q, t in zip(quoted, types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [work(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(made, arrow)], names=[*kept, name]
                )

    return given.mapInArrow(run, ", ".join(filter(None, (fields, f"{name} {ddl}"))))
