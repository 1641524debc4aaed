"""Registry tables at rest.

Three tables are appended per batch. There is no transaction over tables, so a batch ends with its commit mark, and
readers take the rows of marked batches only: a half-written batch shows nowhere. Ids are deterministic, and every batch
writes its own ``batch_id`` partition with dynamic partition overwrite: replaying a batch rewrites the same rows instead of
adding copies. The mark of a batch that is written again goes first, then each of its parts as it is written anew, so the
disk never holds a part twice; a replay that breaks off leaves an unmarked batch, which its next replay writes whole. Its rows
come from elsewhere than the batch's own parts. Ids are hex text, which zstd halves.

Beside the runs lies a table of their keys alone, in folders by hash bucket of the key: whether a batch's runs are known
(J3) is looked up in the buckets of its own keys.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import discard, setting, shuffles_dropped

TABLES = ("experiment_metrics", "checkpoints", "experiments")
KEYS, COMMITS = "run_keys", "commits"
KEY_BUCKETS = 64
#: Tables whose columns are known before a batch has written a row.
_SCHEMAS = {KEYS: "experiment_id string, bucket int, batch_id long", COMMITS: "done boolean, batch_id long"}


def bucket_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def append_part(df: DataFrame, base: str, name: str, batch_id: int, *by: str) -> None:
    """One table's part of a batch; a part written before is replaced."""
    with shuffles_dropped(df.sparkSession):
        (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("compression", "zstd")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(f"{base}/{name}"))


def append_tables(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame, base: str, batch_id: int) -> None:
    """Children, runs, keys, and the mark that makes them visible; idempotent per batch id."""
    discard(runs.sparkSession, f"{base}/{COMMITS}/batch_id={batch_id}")
    for name, df in (("experiment_metrics", metrics), ("checkpoints", checkpoints), ("experiments", runs)):
        discard(runs.sparkSession, f"{base}/{name}/batch_id={batch_id}")
        append_part(df, base, name, batch_id)
    append_part(runs.select("experiment_id", bucket_of("experiment_id").alias("bucket")).repartition("bucket"), base, KEYS, batch_id, "bucket")
    append_part(runs.sparkSession.range(1).select(F.lit(True).alias("done")), base, COMMITS, batch_id)


def _rows(spark: SparkSession, base: str, name: str) -> DataFrame:
    reader = spark.read.schema(_SCHEMAS[name]) if name in _SCHEMAS else spark.read
    return reader.parquet(f"{base}/{name}")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of the batches that are written whole."""
    rows = _rows(spark, base, name)
    if not table_exists(spark, base, COMMITS):
        return rows.where(F.lit(False))
    return rows.join(_rows(spark, base, COMMITS).select("batch_id"), "batch_id", "left_semi").select(rows.columns)


def known_runs(spark: SparkSession, base: str, ids: DataFrame, batch_id: int) -> DataFrame | None:
    """Keys of the runs of earlier batches, from the buckets that ``ids`` fall into; None before the first batch."""
    if not table_exists(spark, base, KEYS):
        return None
    buckets = [r[0] for r in ids.select(bucket_of("experiment_id")).distinct().collect()]  # at most KEY_BUCKETS
    return read_table(spark, base, KEYS).where(F.col("bucket").isin(buckets) & (F.col("batch_id") < batch_id)).select("experiment_id")


def table_exists(spark: SparkSession, base: str, name: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_results_log(log_rows: DataFrame, path: str) -> None:
    """Commit, val_bpb, memory_gb, status, description as tab-separated text with a header."""
    (log_rows.select("commit", "val_bpb", "memory_gb", "status", "description")
     .write.mode("overwrite").option("sep", "\t").option("header", True).csv(path))


def read_results_log(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("sep", "\t").option("header", True)
            .schema("commit STRING, val_bpb STRING, memory_gb DOUBLE, status STRING, description STRING").csv(path))


#: Bytes of input that a task of a bucketed write reads: it sorts all rows it makes of them, and should do so in memory.
SORTED_SPLIT = 8 << 20


def small_splits(spark: SparkSession, size: int = SORTED_SPLIT) -> contextlib.AbstractContextManager[None]:
    """Input splits of at most `size` bytes for the jobs that run inside; the session's own setting afterwards."""
    return setting(spark, "spark.sql.files.maxPartitionBytes", str(size))


def write_bucketed(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame, base: str, n_buckets: int,
                   prefix: str) -> dict[str, str]:
    """The registry at rest bucketed (and sorted) on the run key: runs by ``id``, children by
    ``experiment_uuid``, all with the same bucket count, so per-run aggregates and run-child joins
    read co-located buckets without any shuffle. The tables are registered in the session catalog
    with an explicit path under ``base`` (no metastore service involved). Keys are hex text, which zstd halves; small
    splits keep the sort of a task in memory."""
    spark = runs.sparkSession
    # bucket metadata lives in the catalog; only the in-memory session catalog is used (a Hive
    # catalog would mean a metastore database), otherwise plain parquet views with the same content
    in_memory = spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "in-memory"
    names = {}
    for name, df, key in (("experiments", runs, "id"), ("experiment_metrics", metrics, "experiment_uuid"),
                          ("checkpoints", checkpoints, "experiment_uuid")):
        table = f"{prefix}_{name}"
        if in_memory:
            with small_splits(spark):
                (df.write.mode("overwrite").bucketBy(n_buckets, key).sortBy(key)
                 .option("compression", "zstd").option("path", f"{base}/{name}").saveAsTable(table))
        else:
            df.write.mode("overwrite").parquet(f"{base}/{name}")
            spark.read.parquet(f"{base}/{name}").createOrReplaceTempView(table)
        names[name] = table
    return names
