"""Registered streaming queries (M1-M5). Each writes data derived from the given tables as files
into a fresh folder, runs the stream to completion (``availableNow``) and returns what the sink
holds; the oracle is the SQL of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.plans import standins as st
from runloom.plans.catalog import q6, query, r6, sql_q6
from runloom.plans.q_registry import QUARANTINE_SQL, SUMMARY, _overview_sql, event_payloads
from runloom.plans.q_telemetry import EMA_CTE, EMA_SQL, STOP_CTE, TINCL
from runloom.plans.oracle_views import with_views as W
from runloom.session import work_dir
from runloom.sources import registry_io
from runloom.streaming import ingest as sing
from runloom.streaming import telemetry_state as sts

#: Payloads of a delivered file at most: packed files can't be split, so a task reads one whole.
FILE_ROWS = 50_000


def _write_payloads(p, src):
    (p.write.mode("append").option("ignoreNullFields", False).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(src))


DELIVERIES = ((None, "1995-01-01"), ("1995-01-01", "1998-01-01"), ("1998-01-01", None))


def _deliver_payloads(spark, d, src):
    p = st.payloads(spark, d)
    for lo, hi in DELIVERIES:
        part = p
        if lo:
            part = part.where(F.col("ingest_ts") >= F.lit(lo).cast("timestamp_ntz"))
        if hi:
            part = part.where(F.col("ingest_ts") < F.lit(hi).cast("timestamp_ntz"))
        _write_payloads(part, src)
    return p


#: Micro-batches of a start of the ingest stream, about: each has jobs of its own. A batch's payloads are held until they are
#: registered, so it takes BATCH_FILES files at most.
INGEST_BATCHES, BATCH_FILES = 4, 80


def _files_of_a_batch(spark, src):
    return min(BATCH_FILES, max(2, -(-len(spark.read.text(src).inputFiles()) // INGEST_BATCHES)))


def _ingested(spark, d):
    src, base, cp = work_dir(spark, "stream-src"), work_dir(spark, "stream-registry"), work_dir(spark, "stream-cp")
    p = _deliver_payloads(spark, d, src)
    files = _files_of_a_batch(spark, src)
    sing.start_ingest(spark, src, base, cp, max_files=files)
    # a second delivery of known runs with other values, then a restart from the checkpoint
    dup = (p.where(F.col("status") == "ok").withColumn("status", F.lit("fail"))
           .withColumn("val_bpb", F.lit(None).cast("double")))
    _write_payloads(dup, src)
    sing.start_ingest(spark, src, base, cp, max_files=files)
    return base


@query("stream_ingest", "M1 M2", W(["runs"], f"SELECT {SUMMARY} FROM runs"))
def stream_ingest(spark, d):
    base = _ingested(spark, d)
    runs = registry_io.read_table(spark, base, "experiments")
    return runs.select(*SUMMARY.split(", "))


@query("stream_quarantine", "M1 V1 V2", QUARANTINE_SQL + """
SELECT r.reason, p.payload AS payload FROM r JOIN p USING (event_id) WHERE reason IS NOT NULL
UNION ALL SELECT 'registered', experiment_id FROM r WHERE reason IS NULL""")
def stream_quarantine(spark, d):
    """The payload texts of the batch validator as a stream of files: the same reasons, the rest registered."""
    src, base, cp = work_dir(spark, "quarantine-src"), work_dir(spark, "quarantine-registry"), work_dir(spark, "quarantine-cp")
    event_payloads(spark, d).select("payload").write.text(src)
    sing.start_ingest(spark, src, base, cp, max_files=8)
    bad = registry_io.read_table(spark, base, "quarantine").select("reason", F.col("value").alias("payload"))
    return bad.unionByName(registry_io.read_table(spark, base, "experiments").select(F.lit("registered").alias("reason"), F.col("experiment_id").alias("payload")))


@query("stream_overview", "M3", _overview_sql("runs"))
def stream_overview(spark, d):
    base = _ingested(spark, d)
    sink, cp = work_dir(spark, "overview-sink"), work_dir(spark, "overview-cp")
    sts.start_overview(spark, f"{base}/experiments", sink, cp)
    o = spark.read.parquet(sink)
    return o.withColumn("total_training_seconds", r6("total_training_seconds"))


STEP_CHUNK = 32


def _deliver_steps(spark, d):
    """Step telemetry as files, one file set per range of steps, each run's rows of a range in one
    file: micro-batches then see every run's steps in order."""
    src = work_dir(spark, "steps-src")
    steps = st.training_steps(spark, d)
    top = steps.agg(F.max("step")).first()[0] or 0
    width = max(STEP_CHUNK, -(-(top + 1) // 8))  # at most about 8 deliveries however long the runs are
    for lo in range(0, top + 1, width):
        (steps.where((F.col("step") >= lo) & (F.col("step") < lo + width))
         .repartition("experiment_id").sortWithinPartitions("experiment_id", "step")
         .write.mode("append").parquet(src))
    return src


@query("stream_loss_ema", "M4", EMA_SQL)
def stream_loss_ema(spark, d):
    src = _deliver_steps(spark, d)
    sink, cp = work_dir(spark, "ema-sink"), work_dir(spark, "ema-cp")
    sts.start_loss_ema(spark, src, sink, cp)
    out = spark.read.parquet(sink)
    return out.select("experiment_id", "step", q6("smooth_loss").alias("smooth_loss"), q6("ema_loss").alias("ema_loss"))


#: Rows of a file of a shuffled delivery, about.
DELIVERY_ROWS = 1_000_000


def _deliver_shuffled(spark, d, deliveries=4):
    """Step telemetry in deliveries that take no account of its order: every run's steps come late and with gaps. The folder, and
    the files of a delivery, which one micro-batch takes; the steps are computed in the tasks of their own stage."""
    src = work_dir(spark, "steps-shuffled")
    steps = st.training_steps(spark, d).withColumn("_d", F.pmod(F.xxhash64("experiment_id", "step"), F.lit(deliveries)))
    files = -(-max(1, steps.count()) // (deliveries * DELIVERY_ROWS))  # of a delivery
    for i in range(deliveries):
        steps.where(F.col("_d") == i).drop("_d").repartition(files, "experiment_id", "step").write.mode("append").parquet(src)
    return src, files


STATE_SQL = W(["training_steps"], f"""
SELECT e.experiment_id, e.step, {sql_q6("e.s")} AS smooth_loss, round(t.t_incl, 6) AS training_time,
  {sql_q6("min(CASE WHEN NOT isnan(e.s) THEN e.s / (1 - pow(CAST(0.9 AS DOUBLE), e.step + 1)) END) OVER (PARTITION BY e.experiment_id ORDER BY e.step ROWS UNBOUNDED PRECEDING)")} AS best_loss,
  CASE WHEN x.stop_reason = 'fail' AND e.step = x.fail_step THEN 'fail' WHEN x.stop_reason = 'time' AND e.step = x.time_step THEN 'time' END AS stop_reason,
  e.step > CASE x.stop_reason WHEN 'fail' THEN x.fail_step WHEN 'time' THEN x.time_step ELSE x.max_step END AS after_stop
FROM e JOIN (SELECT *, {TINCL} AS t_incl FROM training_steps) t ON t.experiment_id = e.experiment_id AND t.step = e.step
JOIN (SELECT s.*, m.max_step FROM stops s JOIN (SELECT experiment_id, max(step) AS max_step FROM training_steps GROUP BY 1) m USING (experiment_id)) x
  ON x.experiment_id = e.experiment_id""", recursive=True, extra=[EMA_CTE, STOP_CTE])


@query("stream_step_state", "M4 W3 W4 W8 (late and shuffled deliveries)", STATE_SQL)
def stream_step_state(spark, d):
    src, files = _deliver_shuffled(spark, d)
    sink, cp = work_dir(spark, "state-sink"), work_dir(spark, "state-cp")
    sts.start_loss_ema(spark, src, sink, cp, max_files=files)
    return spark.read.parquet(sink).select("experiment_id", "step", q6("smooth_loss").alias("smooth_loss"), r6("training_time").alias("training_time"),
                                           q6("best_loss").alias("best_loss"), "stop_reason", "after_stop")


@query("stream_failures", "M5 P14", W(["training_steps"], """
SELECT experiment_id, step, loss FROM training_steps WHERE isnan(loss) OR loss > 100"""))
def stream_failures(spark, d):
    src = _deliver_steps(spark, d)
    sink, cp = work_dir(spark, "fail-sink"), work_dir(spark, "fail-cp")
    sts.start_failures(spark, src, sink, cp)
    return spark.read.parquet(sink).select("experiment_id", "step", "loss")
