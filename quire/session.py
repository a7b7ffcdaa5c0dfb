"""Spark session defaults and small cluster-safety helpers.

Every job in the package works on any session; ``get_spark`` only fills in the
settings the engine relies on (UTC wall clock, AQE, Arrow) when the caller has
not set them.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine's semantics depend on (timestamps are parsed and printed
# in UTC) or that keep plans healthy at scale (AQE coalesce + skew split).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: By this setting of Spark a query's shuffle files go when it ends, not when the driver next collects garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The lists of folders that the thread's open ``passing`` blocks will delete, the innermost last.
_PASSING = threading.local()


def get_spark(master: str | None = None, app: str = "quire",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem), else
    an error says so; only on a local master a scratch folder is created.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quire-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - core confs may refuse runtime changes; the context still gets it
            pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike localCheckpoint).

    The frame is persisted while the checkpoint is written: an unpersisted
    checkpoint computes its input twice (once for the job, once for the
    files), which would repeat every expensive step (or external call)."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the folder of ``checkpoint_dir`` and
    read back; each call takes a folder of its own, which an open ``passing``
    block deletes at its end."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    blocks = getattr(_PASSING, "blocks", None)
    if blocks:
        blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a finished query go at once, so that passes
    one after the other take the disk of one."""
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)


@contextmanager
def passing(spark: SparkSession):
    """For steps whose results are elsewhere when they end: what ``written``
    writes inside (in this thread) is deleted at the end, and shuffle files go
    with their query."""
    if not hasattr(_PASSING, "blocks"):
        _PASSING.blocks = []
    paths: list[str] = []
    _PASSING.blocks.append(paths)
    try:
        with shuffles_dropped(spark):
            yield
    finally:
        _PASSING.blocks = [b for b in _PASSING.blocks if b is not paths]
        sc = spark.sparkContext
        for path in paths:
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in Python workers (the Arrow steps unpickle
    its functions by module name). The package is zipped once per Spark
    context and distributed with ``addPyFile``; workers put it on their path
    whatever the driver's working directory is."""
    import zipfile
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Connect): nothing to ship from here
        return
    key = id(sc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, zpath = tempfile.mkstemp(prefix="quire-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
