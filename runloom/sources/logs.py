"""Run logs (S16, S17) as the training job writes them: one file holds the job's lines, the step lines that overwrite each
other behind carriage returns, and at the end, if the run gets there, the summary block (`key: value` lines after `---`).

Spark's text reader takes \\r, \\n and \\r\\n as line ends, so one splittable read gives all lines of mixed files; lines belong
together by their file's path, and a run's name stands in its `Experiment:` line. Nothing relies on the order of lines.
A log may be rotated: then every file of the run repeats that line. A line that was cut when a run was killed is no
step line. A log without a val_bpb line is that of a killed run.

Fixed values: the step line format
  step {step:05d} ({pct:.1f}%) | loss: {loss:.6f} | lrm: {lrm:.2f} | dt: {dt_ms:.0f}ms | tok/sec: {tps:,} | mfu: {mfu:.1f}% | epoch: {epoch} | remaining: {rem:.0f}s
the lines `Experiment: <run>`, `FAIL` and `Training crashed: <message>`, and the summary keys, in order: val_bpb (6 decimals, 'n/a' when unscored), training_seconds (1),
total_seconds (1), peak_vram_mb (1), mfu_percent (2), total_tokens_M (1), num_steps, num_params_M (1), depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY_KEYS = ("val_bpb", "training_seconds", "total_seconds", "peak_vram_mb", "mfu_percent", "total_tokens_M",
                "num_steps", "num_params_M", "depth")

STEP_RE = (r"^step (\d+) \(([\d.]+)%\) \| loss: ([\d.naNinf-]+) \| lrm: ([\d.]+) \| dt: (\d+)ms \| "
           r"tok/sec: ([\d,]+) \| mfu: ([\d.]+)% \| epoch: (\d+) \| remaining: (\d+)s")


def step_lines(steps: DataFrame) -> DataFrame:
    """(experiment_id, step, line) from a frame with step, pct_done, ema_loss, lrm, dt, tok_per_sec,
    mfu, epoch, remaining."""
    line = F.format_string(
        "step %05d (%.1f%%) | loss: %.6f | lrm: %.2f | dt: %.0fms | tok/sec: %,d | mfu: %.1f%% | epoch: %d | remaining: %.0fs    ",
        F.col("step"), F.col("pct_done"), F.col("ema_loss"), F.col("lrm"), F.col("dt") * 1000,
        F.coalesce(F.col("tok_per_sec"), F.lit(0)), F.coalesce(F.col("mfu"), F.lit(0.0)), F.col("epoch"),
        F.col("remaining"))
    return steps.select("experiment_id", "step", line.alias("line"))


def summary_block(s: DataFrame) -> F.Column:
    """The block after the step lines, in key order."""
    lines = [
        F.lit("---"),
        F.concat(F.lit("val_bpb:          "), F.when(F.col("val_bpb").isNull(), F.lit("n/a"))
                 .otherwise(F.format_string("%.6f", F.col("val_bpb")))),
        F.format_string("training_seconds: %.1f", F.col("training_seconds")),
        F.format_string("total_seconds:    %.1f", F.col("total_seconds")),
        F.format_string("peak_vram_mb:     %.1f", F.col("peak_vram_mb")),
        F.format_string("mfu_percent:      %.2f", F.col("mfu_percent")),
        F.format_string("total_tokens_M:   %.1f", F.col("total_tokens") / F.lit(1e6)),
        F.format_string("num_steps:        %d", F.col("num_steps")),
        F.format_string("num_params_M:     %.1f", F.col("num_params") / F.lit(1e6)),
        F.format_string("depth:            %d", F.col("depth")),
    ]
    return F.array_join(F.array(*lines), "\n")


def write_logs(lines: DataFrame, summary: DataFrame, path: str, steps_a_file: int = 2_000) -> None:
    """Logs in one flat folder, a file for every `steps_a_file` steps of a run (a row holds no more than those). `lines` as
    of :func:`step_lines`; `summary` has a row for every run: its values, `how` it ended (ok, fail, crash, killed)
    and, for a crash, its message."""
    part = F.floor(F.col("step") / steps_a_file).cast("int")
    texts = (lines.groupBy("experiment_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("step", "line"))).alias("rows"))
             .select("experiment_id", "part", F.array_join(F.transform("rows", lambda r: F.concat(F.lit("\r"), r["line"])), "").alias("text")))
    last = F.floor(F.greatest(F.col("num_steps") - 1, F.lit(0)) / steps_a_file).cast("int")
    parts = summary.withColumn("last", last).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    end = (F.when(F.col("how") == "killed", F.lit(" | los"))
           .when(F.col("how") == "fail", F.concat(F.lit("FAIL\n\n"), summary_block(summary)))
           .when(F.col("how") == "crash", F.concat(F.lit("\nTraining crashed: "), F.col("message"), F.lit("\n\n"), summary_block(summary)))
           .otherwise(F.concat(F.lit("\n"), summary_block(summary))))
    whole = F.concat(F.lit("Experiment: "), F.col("experiment_id"), F.lit("\nTime budget: 300s\n"), F.coalesce("text", F.lit("")),
                     F.when(F.col("part") == F.col("last"), end).otherwise(F.lit("")))
    (parts.join(texts, ["experiment_id", "part"], "left").select(whole.alias("value"))
     .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): all lines of all logs, whichever way they end."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.rtrim("value").alias("value"))


def log_files(lines: DataFrame) -> DataFrame:
    """(file, experiment_id): one row a file; NULL without an `Experiment:` line."""
    name = F.regexp_extract("value", r"^Experiment: (\S+)$", 1)
    return lines.groupBy("file").agg(F.max(F.when(name != "", name)).alias("experiment_id"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The values of every run (of every file without a run's name); 'n/a' is NULL; a run without a val_bpb line was
    killed, one that says so failed or crashed."""
    lines = read_lines(spark, path)
    key, val = (F.regexp_extract("value", r"^(\w+):\s+(\S+)$", i) for i in (1, 2))
    crash = F.regexp_extract("value", r"^Training crashed: (.*)$", 1)
    name = F.regexp_extract("value", r"^Experiment: (\S+)$", 1)
    step = F.regexp_extract("value", STEP_RE, 1)
    # one partial row a file and task: the shuffle carries files, not lines
    files = lines.groupBy("file").agg(
        F.max(F.when(name != "", name)).alias("experiment_id"), *[F.max(F.when(key == k, val)).alias(k) for k in SUMMARY_KEYS],
        F.max(F.when(F.col("value").startswith("Training crashed:"), crash)).alias("crash_message"),
        F.bool_or(F.col("value").rlike(r"(^|remaining: \d+s +)FAIL$")).alias("failed"),
        F.max(F.when(step != "", step).cast("int")).alias("last_step"))
    runs = files.groupBy(F.coalesce("experiment_id", "file").alias("experiment_id")).agg(
        *[F.max(k).alias(k) for k in (*SUMMARY_KEYS, "crash_message", "last_step")], F.bool_or("failed").alias("failed"))
    num = lambda k: F.when(F.col(k) != "n/a", F.col(k)).try_cast("long" if k in ("num_steps", "depth") else "double")
    status = (F.when(F.col("val_bpb").isNull(), F.lit("killed")).when(F.col("crash_message").isNotNull(), F.lit("crash"))
              .when(F.col("failed"), F.lit("fail")).otherwise(F.lit("ok")))
    return runs.select("experiment_id", status.alias("status"), *[num(k).alias(k) for k in SUMMARY_KEYS], "crash_message", "last_step",
                       F.col("val_bpb").isNull().alias("crashed"), num("val_bpb").isNotNull().alias("scored"))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The step lines of all logs, parsed with one regular expression; a run is named by its file."""
    lines = read_lines(spark, path)
    g = lambda i: F.regexp_extract("value", STEP_RE, i)
    out = lines.where(F.col("value").startswith("step ")).select(
        "file", g(1).alias("step_s"), g(2).alias("pct"), g(3).alias("loss"), g(4).alias("lrm"), g(5).alias("dt_ms"),
        F.regexp_replace(g(6), ",", "").alias("tok_per_sec"), g(7).alias("mfu"), g(8).alias("epoch"), g(9).alias("remaining"))
    out = out.where(F.col("step_s") != "").join(log_files(lines), "file", "left")
    return out.select(F.coalesce("experiment_id", "file").alias("experiment_id"), F.col("step_s").cast("int").alias("step"), F.col("pct").cast("double").alias("pct_done"),
                      F.col("loss").try_cast("double").alias("loss"), F.col("lrm").cast("double").alias("lrm"),
                      F.col("dt_ms").cast("long").alias("dt_ms"), F.col("tok_per_sec").cast("long").alias("tok_per_sec"),
                      F.col("mfu").cast("double").alias("mfu"), F.col("epoch").cast("int").alias("epoch"),
                      F.col("remaining").cast("long").alias("remaining"))
