"""Run result documents as files.

The training job writes one pretty-printed JSON object per run file named by its time-stamped
run id; :func:`read_results` reads such files (``multiLine``). Bulk results are written as JSON
lines partitioned by arrival month (one file per run would be a small-files problem at scale),
and "the latest result" is the greatest (file path, run id): for time-stamped ids that is the same
as the greatest file name of the one-file-per-run layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from runloom.schemas import RESULT_SCHEMA

RESULT_FILE_SCHEMA = StructType(list(RESULT_SCHEMA.fields) + [StructField("ingest_ts", TimestampNTZType())])


def write_results(payloads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: NULL fields are written, not dropped; partitioned by arrival month."""
    month = F.date_format(F.col("ingest_ts"), "yyyy-MM")
    # no shuffle: every task writes its own files into the month folders (a hot month is just more files)
    (payloads.withColumn("ingest_month", month).write.mode(mode)
     .option("ignoreNullFields", False).partitionBy("ingest_month").json(path))


def read_results(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Documents read with a fixed schema; ``multiline`` for pretty-printed one-object files.
    The source path is kept for S2."""
    df = (spark.read.schema(RESULT_FILE_SCHEMA).option("multiLine", multiline)
          .option("mode", "PERMISSIVE").json(path))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def latest_result(results: DataFrame, one_per_file: bool = False) -> DataFrame:
    """The latest result, not the newest modification time. With one result a file it is the one with the
    greatest file name, whatever ids the files hold, and no file at all is an error. In the bulk layout, whose file
    names mean nothing, it is the greatest (folder, run id), and empty input gives no row. A global aggregate: one partial row per task."""
    cols = [c for c in results.columns if c not in ("source_file", "ingest_month")]
    if one_per_file:
        latest_by = F.struct(F.regexp_extract("source_file", "([^/]*)$", 1), F.col("source_file"))
    else:
        latest_by = F.struct(F.regexp_replace(F.col("source_file"), "/[^/]*$", ""), F.col("experiment_id"))
    picked = results.agg(F.max_by(F.struct(*cols), latest_by).alias("r"), F.count(F.lit(1)).alias("n_results"))
    if one_per_file:
        none = F.raise_error(F.lit("no result files")).cast("long")
        picked = picked.withColumn("n_results", F.when(F.col("n_results") > 0, F.col("n_results")).otherwise(none))
        return picked.select("r.*", "n_results")
    return picked.where(F.col("r").isNotNull()).select("r.*", "n_results")
