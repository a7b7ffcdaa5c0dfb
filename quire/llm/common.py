"""Helpers shared by the operators: table reads, written intermediates, text
columns, and bounded samples of labelled rows."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import CLEANUP_SETTING, checkpoint_dir, ship_package, shuffles_dropped  # noqa: F401

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: A word: a maximal run of other characters (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch between Spark and a task's Python, where the session
#: names none; both sides hold a few of them for each task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Labels are learned only from rows whose remainder is not 0.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder of
    ``spark.checkpoint.dir`` and read back: its lineage is cut, and a lost
    executor costs a re-read, not a recomputation. Each call takes a folder of
    its own, so that reruns never meet old files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(id_column: str = "doc_id") -> Column:
    """Is the row kept away from training? (crc32 of the id as text, modulo
    ``FOLDS``, is 0; rows without an id are never trained on.)"""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % FOLDS == 0


def small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches hold at most ``BATCH_BYTES``, unless it names another size."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def freeing(step: Callable) -> Callable:
    """The Arrow step; at its end, what the allocators hold unused goes back
    to the system (a worker lives on to the next task and stage)."""
    def run(batches):
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)
    return run


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers, in small batches,
    that gives unused memory back after each task."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(freeing(function), schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, to bound what a step
    holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def labelled(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """(_id, _y) of every labelled id outside the held-out fold. A document
    labelled twice counts once, with its larger label."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    return known.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_y")).where("_y in (0, 1)")


def labelled_ids(labels: DataFrame, label: str, rows: int, id_column: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, picked by the
    order of a hash of the id, half of them (where there are so many) from
    each class. The result is bounded by ``rows``, so a caller may broadcast it."""
    known = labelled(labels, label, id_column)
    each = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows // 2) for y in (0, 1)]
    return each[0].unionAll(each[1])


def one_of_each(df: DataFrame, id_column: str) -> DataFrame:
    """One row of each id, the smallest by the other columns in their order;
    reduced on the executors, before a shuffle."""
    rest = [c for c in df.columns if c != id_column]
    return df.groupBy(id_column).agg(F.min(F.struct(*rest)).alias("_row")).select(id_column, "_row.*")
