"""Corpus split files.

The split is written as parquet partitioned by ``split``; the raw table sits next to it as its own
partition (``split=raw``) so that reading "the data files" is a partition filter, and stray
temporary files are skipped by a file-name glob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_splits(split_docs: DataFrame, path: str, overwrite: bool = False) -> bool:
    """S6 + S15: write (doc_id, text, split) partitioned by split. Skipped when the output already
    exists unless ``overwrite``; returns True when something was written."""
    spark = split_docs.sparkSession
    if not overwrite and exists(spark, f"{path}/_SUCCESS"):
        return False
    (split_docs.select("doc_id", "text", "split").write.mode("overwrite")
     .partitionBy("split").parquet(path))
    return True


def write_raw(docs: DataFrame, path: str, keep_raw: bool = True) -> None:
    """The raw table beside the splits (``--keep-raw``): stored as partition ``split=raw``."""
    if keep_raw:
        docs.select("doc_id", "text").write.mode("ignore").parquet(f"{path}/split=raw")


def touch(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def read_data_files(spark: SparkSession, path: str) -> DataFrame:
    """S7 + S4: only ``*.parquet`` files, never the raw table, never temporary files."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return (df.where(F.col("split") != "raw")
            .withColumn("file_name", F.col("_metadata.file_name"))
            .where(~F.col("file_name").endswith(".tmp")))
