"""Session helpers: building a session for tests and locating shared scratch space.

Library code never invents a machine-local folder: every intermediate table
is written below ``spark.checkpoint.dir``, which on a cluster names a shared
file system.  Only on a local master is one created when the setting is missing;
anywhere else that is an error.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tessera",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (a cluster passes its own session in)."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


TIME_ZONE = "spark.sql.session.timeZone"


@contextmanager
def utc(spark: SparkSession):
    """Plans made inside read dates in UTC (the zone is fixed when a plan is analysed); the
    caller's setting is back afterwards, and no other setting is touched."""
    before = spark.conf.get(TIME_ZONE)
    spark.conf.set(TIME_ZONE, "UTC")
    try:
        yield spark
    finally:
        spark.conf.set(TIME_ZONE, before)


_CACHES: list[dict] = []


def cache() -> dict:
    """A dictionary of written tables that :func:`drop_scratch` empties."""
    kept: dict = {}
    _CACHES.append(kept)
    return kept


def folder_state(spark: SparkSession, path: str) -> int:
    """Hash of names, sizes and times of the files of an input folder (two levels deep), so that
    what is kept of it is not used after the files change."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for entry in fs.listStatus(hadoop):
        files = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return hash(tuple(sorted(found)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; created only when unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder, private to this application."""
    base = checkpoint_dir(spark)
    app = spark.sparkContext.applicationId or "app"
    return os.path.join(base, "tessera", app, *parts)


def fresh_path(spark: SparkSession, prefix: str) -> str:
    return scratch_path(spark, f"{prefix}-{uuid.uuid4().hex[:12]}")


#: settings of the jobs that write intermediate tables: a join whose smaller side came out of its shuffle in parts of at
#: most 64 MB looks its rows up in a hash table (neither side is sorted, so nothing is spilled for it), and a partitioned
#: write keeps a file open for each of a few values instead of sorting the rows
WRITE_CONF = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB", "spark.sql.maxConcurrentOutputFileWriters": "16"}
_WRITING = {"now": 0, "before": {}}
_WRITING_LOCK = threading.Lock()


@contextmanager
def unsorted_writes(spark: SparkSession):
    """``WRITE_CONF`` while tables are written, from one thread or several; the caller's settings are back afterwards."""
    with _WRITING_LOCK:
        if not _WRITING["now"]:
            _WRITING["before"] = {k: spark.conf.get(k, None) for k in WRITE_CONF}
            for k, v in WRITE_CONF.items():
                spark.conf.set(k, v)
        _WRITING["now"] += 1
    try:
        yield spark
    finally:
        with _WRITING_LOCK:
            _WRITING["now"] -= 1
            if not _WRITING["now"]:
                for k, v in _WRITING["before"].items():
                    if v is None:
                        spark.conf.unset(k)
                    else:
                        spark.conf.set(k, v)


def write_read(df, path: str, partition_by: str | None = None):
    """``df`` written as parquet to ``path`` and read back."""
    writer = df.write.mode("overwrite")
    with unsorted_writes(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df, prefix: str = "tbl"):
    """Write ``df`` as parquet below the shared checkpoint folder and read it back.

    One computation (an eager ``checkpoint()`` computes its input twice), lineage cut at
    the table, and the result survives the loss of any executor."""
    return write_read(df, fresh_path(df.sparkSession, prefix))


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's scratch folder (written star schema, splits, model sets)
    through the Hadoop FileSystem of the checkpoint folder.  Call once the results are
    no longer needed; other applications' folders are untouched, and tables kept for reuse are
    forgotten."""
    for kept in _CACHES:
        kept.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
