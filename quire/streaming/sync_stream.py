"""M1: pick up new snapshot folders as their files arrive, diff, publish.

Two file streams carry what arrives: the entries of index files (which content
files a snapshot names) and the names of content files, whose contents are not
read. Both go to one stateful operator keyed by snapshot (``Arrivals``), which
holds for each of a snapshot's files whether it was named and whether it is
there, and how many are still missing. It emits a snapshot once:

* when every file that the index names is there (and, where the index is a
  folder, every file that is there is named, so that no part of the index is
  missing), in whatever batches and order they came; or
* when no file has changed for ``settle_seconds``, which a timer looks for in
  every batch while the snapshot waits (a snapshot may name a file that never
  comes; its labels are then skipped like any missing hop).

No batch lists the folders again. Each emitted snapshot is imported, published
as a new version (L2) and compared with the version before (L1), and its sync
record is appended (E7). The version log names the commit, so a batch that runs
again after a failure publishes nothing twice, and one that failed between the
publish and its record writes the record only.

State is kept in RocksDB under the checkpoint folder, which must be on the
shared filesystem; it defaults to a sub-folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import os
from contextlib import closing

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.diff import snapshot_diff, sync_summary
from ..plans.import_items import import_items
from ..plans.publish import TableStore
from ..session import checkpoint_dir, passing
from ..sources import snapshots as S
from . import state
from .state import READY_SCHEMA, Arrivals

SYNC_SCHEMA = T.StructType([
    T.StructField("snapshot", T.StringType()),
    T.StructField("dataset_commit", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("added", T.LongType()),
    T.StructField("updated", T.LongType()),
    T.StructField("unchanged", T.LongType()),
    T.StructField("removed", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("processing_time_ms", T.LongType()),
    T.StructField("synced_at", T.TimestampNTZType()),
])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state has a key for each snapshot, and each partition of it files of about 4 MB, used or not:
#: so many partitions at most, whatever the session's joins have (a checkpoint keeps the number that it began with).
PARTITIONS_SETTING, STATE_PARTITIONS = "spark.sql.shuffle.partitions", 8


def arrivals(spark: SparkSession, raw_root: str) -> DataFrame:
    """Streaming rows for ``Arrivals``: (snapshot, kind, file, folder, changed_ms)."""
    root = raw_root.rstrip("/")
    changed = lambda c: F.unix_millis(c)
    # cut at "}", an index of any size is many rows; each entry's record ends at one
    index = (spark.readStream.option("lineSep", "}").text(f"{root}/scp-*/items/index.json")
             .select(F.col("_metadata.file_path").alias("path"), changed(F.col("_metadata.file_modification_time")).alias("changed_ms"), "value"))
    named = F.regexp_extract("value", r'"content_file"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    named = F.get(F.from_json(F.concat(F.lit("["), named, F.lit("]")), "array<string>"), F.lit(0))
    index = index.select("path", F.lit("index").alias("kind"), named.alias("file"), F.col("path").rlike(r"/index\.json/").alias("folder"), "changed_ms")
    content = (spark.readStream.format("binaryFile").option("pathGlobFilter", S.CONTENT_GLOB)
               .schema("path string, modificationTime timestamp, length long, content binary").load(f"{root}/scp-*/items")
               .where(~F.col("path").rlike(r"/index\.json")))
    content = content.select("path", F.lit("content").alias("kind"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                             F.lit(False).alias("folder"), changed(F.col("modificationTime")).alias("changed_ms"))
    both = index.unionByName(content)
    return both.select(F.regexp_extract("path", r"(scp-[^/]+)/items/", 1).alias("snapshot"), "kind", "file", "folder", "changed_ms")


def ready_snapshots(spark: SparkSession, raw_root: str, settle_seconds: int = 300) -> DataFrame:
    """Streaming (snapshot, reason, n_named, n_arrived): each snapshot once, when it is due."""
    return arrivals(spark, raw_root).groupBy("snapshot").transformWithStateInPandas(
        Arrivals(settle_seconds), READY_SCHEMA, "Append", "ProcessingTime")


def sync_snapshot(spark: SparkSession, raw_root: str, table_root: str, snapshot: str,
                  table: str = "items", staging_dir: str | None = None) -> dict | None:
    """Import (with the staged texts), publish and diff one snapshot; None if
    it is published and recorded already. The diff compares two published
    versions, so that only the import reads the content."""
    store = TableStore(spark, table_root)
    commit = spark.range(1).select(S.commit_of(F.lit(snapshot)).alias("c")).first()["c"]
    known = store.versions(table).where(F.col("dataset_commit").eqNullSafe(F.lit(commit))).select("version").first()
    if known is not None and sync_log(spark, table_root).where(F.col("version") == known["version"]).limit(1).count():
        return None
    t0 = dt.datetime.now()
    errors = 0

    def parts():
        """Each part's items are written once, published and their errors counted."""
        nonlocal errors
        with closing(import_items(spark, raw_root, staging_dir, snapshot=snapshot, materialize=True).rounds()) as rounds:
            for items, wrong in rounds:
                yield items
                errors += wrong.count()

    with passing(spark):
        # known already: published by a run that ended before its record
        if known is None:
            with closing(parts()) as all_parts:
                version = store.publish(all_parts, table, commit)
        else:
            version = known["version"]
            for _ in parts():
                pass
    new = store.read(table, version).select("link", "content_sha1")
    before = store.versions(table).where(F.col("version") < version).agg(F.max("version")).first()[0]
    old = store.read(table, before).select("link", "content_sha1") if before is not None else new.limit(0)
    counts = {"added": 0, "updated": 0, "unchanged": 0, "removed": 0}
    counts.update({r["state"]: r["n_items"] for r in sync_summary(snapshot_diff(old, new)).collect()})
    ms = int((dt.datetime.now() - t0).total_seconds() * 1000)
    rec = {"snapshot": snapshot, "dataset_commit": commit, "version": version, **counts,
           "errors": errors, "processing_time_ms": ms, "synced_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
    spark.createDataFrame([rec], SYNC_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{table_root.rstrip('/')}/_syncs")
    return rec


def sync_stream(spark: SparkSession, raw_root: str, table_root: str, checkpoint: str | None = None,
                available_now: bool = True, processing_time: str | None = None, settle_seconds: int = 300,
                staging_dir: str | None = None):
    """Start the stream; returns the StreamingQuery. With ``available_now`` it
    is one batch over all files that have come since the last run (await its
    termination); timers that are due fire in it, with new files or without.
    (The trigger of that name would run batches without data for ever, because
    an operator with processing-time timers always asks for another.)"""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "sync_stream")
    # the stream's planner starts the operator in a process of its own, which has no shipped packages
    cloudpickle.register_pickle_by_value(state)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # the snapshots that became due in this batch, each a publish of its own, oldest first
        for r in sorted(batch.collect(), key=lambda r: r["snapshot"]):
            sync_snapshot(spark, raw_root, table_root, r["snapshot"], staging_dir=staging_dir)

    # read when the stream starts; the operator's timers and maps need this store
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    settings[PARTITIONS_SETTING] = str(min(STATE_PARTITIONS, int(spark.conf.get(PARTITIONS_SETTING))))
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        w = ready_snapshots(spark, raw_root, settle_seconds).writeStream.outputMode("append")
        w = w.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        if available_now:
            w = w.trigger(once=True)
        elif processing_time:
            w = w.trigger(processingTime=processing_time)
        return w.start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def sync_log(spark: SparkSession, table_root: str) -> DataFrame:
    """Every sync's record; no rows before the first."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(SYNC_SCHEMA).parquet(f"{table_root.rstrip('/')}/_syncs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SYNC_SCHEMA)
