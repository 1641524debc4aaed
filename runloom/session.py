"""Session construction and the shared working folder.

On a cluster the working folder is the shared checkpoint folder the cluster names in
``spark.checkpoint.dir``; a local fallback is created only when that setting is absent and the
master is local (tests, laptops).
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(master: str | None = None, app: str = "runloom", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # broadcast only small sides that AQE has measured; explicit hints are size checked
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.driver.memory": "8g",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join(name, os.path.relpath(os.path.join(folder, f), root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: ``spark.checkpoint.dir`` or the context's own.

    Where neither is set, a local master gets a folder of its own; on a cluster that would scatter the data over the
    executors' disks, so it is an error there.
    """
    sc = spark.sparkContext
    cp = sc.getCheckpointDir()
    if not cp:
        cp = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not cp:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            cp = _LOCAL_FALLBACK.get(sc.applicationId)
            if cp is None:
                cp = tempfile.mkdtemp(prefix="runloom-ckpt-")
                _LOCAL_FALLBACK[sc.applicationId] = cp
        sc.setCheckpointDir(cp)
        cp = sc.getCheckpointDir() or cp
    return cp.rstrip("/")


def work_dir(spark: SparkSession, name: str, fresh: bool = True) -> str:
    """A folder under the shared checkpoint base; ``fresh`` gives a new unique one."""
    base = checkpoint_base(spark)
    sub = f"{name}-{uuid.uuid4().hex[:12]}" if fresh else name
    return f"{base}/runloom/{sub}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside; the one before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of the writes that run inside go when their write ends, not when the driver happens to collect its
    garbage: the disk holds those of one write."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
