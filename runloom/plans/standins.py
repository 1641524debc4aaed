"""Stand-in views over the given tables (see SURVEY §7.3).

The given tables carry no training runs, so runs, metrics, checkpoints, submissions, step
telemetry, the story corpus and free-form configurations are *derived* from them by fixed rules.
The DuckDB oracle (``runloom.plans.oracle``) defines the same views as SQL CTEs; both sides must
stay rule-for-rule identical.

Rules (fixed values):
- payloads from orders: experiment_id 'exp_<o_orderkey>'; status O/F/P -> ok/fail/crash;
  val_bpb for ok runs = ((round(o_totalprice*100) % 900000) + 100000) / 1e6;
  training_seconds = floor(o_totalprice/10)/10; total_seconds = training + 15;
  peak_vram_mb = (o_custkey % 64) * 512; mfu_percent = (o_orderkey % 4000)/100;
  num_steps = o_orderkey % 1000; total_tokens = num_steps * 16384;
  num_params = 4194440 + (o_orderkey % 97) * 1024; depth = 2 + o_orderkey % 6;
  git_commit = sha1(key), doubled for priority 1-URGENT; git_dirty NULL for 5-LOW else o_custkey odd;
  checkpoint_path for ok runs 'ckpt/<id>.pt' ('' for 3-MEDIUM); configuration JSON with
  max_seq_len 128*(1+o_custkey%4), vocab_size 512*(1+o_orderkey%4), window_pattern L/SL/SSSL by
  o_orderkey%3 (NULL for 4-NOT SPECIFIED); parent 'exp_<o_orderkey-1>' unless o_orderkey%8 = 0;
  crash_message 'crash: <priority>' for crashes; arrival / ingest time = o_orderdate.
- metrics from lineitem: run 'exp_<l_orderkey>', quantity/extendedprice/discount/tax at step
  l_linenumber, recorded at l_shipdate.
- submissions from lineitem: one payload per line for run 'exp_<l_orderkey>', status by return
  flag N/R/A -> ok/fail/crash, arrival (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice).
- training steps from events: run 'run_<user_id>', step = order of (ts, event_id) from 0,
  loss = value, dt = microseconds since the user's previous event / 1e9 (0 for the first),
  vram_bytes = event_id * 1048576.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.functions.config import epoch_micros
from runloom.operators import registry as reg
from runloom.sources.tables import read_table

def _status(code: Column, ok: str, fail: str) -> Column:
    return F.when(code == ok, F.lit("ok")).when(code == fail, F.lit("fail")).otherwise(F.lit("crash"))


def _bpb(price: Column) -> Column:
    return (F.round(price * 100).cast("long") % 900000 + 100000) / F.lit(1e6)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    eid = F.concat(F.lit("exp_"), ks)
    prio = F.col("o_orderpriority")
    ok = F.col("o_orderstatus") == "O"
    sha = F.sha1(ks)
    train_s = F.floor(F.col("o_totalprice") / 10) / F.lit(10.0)
    steps = k % 1000
    pattern = F.when(k % 3 == 0, F.lit("L")).when(k % 3 == 1, F.lit("SL")).otherwise(F.lit("SSSL"))
    conf = F.when(prio == "4-NOT SPECIFIED", F.lit(None).cast("string")).otherwise(F.concat(
        F.lit('{"max_seq_len": '), (128 * (1 + F.col("o_custkey") % 4)).cast("string"),
        F.lit(', "vocab_size": '), (512 * (1 + k % 4)).cast("string"),
        F.lit(', "window_pattern": "'), pattern, F.lit('"}')))
    return o.select(
        eid.alias("experiment_id"),
        F.when(prio == "1-URGENT", F.concat(sha, sha)).otherwise(sha).alias("git_commit"),
        F.when(prio == "5-LOW", F.lit(None).cast("boolean")).otherwise(F.col("o_custkey") % 2 == 1).alias("git_dirty"),
        _status(F.col("o_orderstatus"), "O", "F").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("crash: "), prio)).alias("crash_message"),
        F.when(ok, _bpb(F.col("o_totalprice"))).alias("val_bpb"),
        train_s.alias("training_seconds"),
        (train_s + F.lit(15.0)).alias("total_seconds"),
        ((F.col("o_custkey") % 64) * F.lit(512.0)).alias("peak_vram_mb"),
        ((k % 4000) / F.lit(100.0)).alias("mfu_percent"),
        (steps * 16384).alias("total_tokens"),
        steps.alias("num_steps"),
        (F.lit(4194440) + (k % 97) * 1024).cast("long").alias("num_params"),
        (2 + k % 6).cast("int").alias("depth"),
        F.when(ok, F.when(prio == "3-MEDIUM", F.lit("")).otherwise(F.concat(F.lit("ckpt/"), eid, F.lit(".pt"))))
         .alias("checkpoint_path"),
        conf.alias("configuration"),
        F.when(k % 8 != 0, F.concat(F.lit("exp_"), (k - 1).cast("string"))).alias("parent_experiment_id"),
        F.col("o_orderdate").alias("ingest_ts"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.payload_to_runs(payloads(spark, sf_dir), "ingest_ts")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.payload_to_checkpoints(payloads(spark, sf_dir), "ingest_ts")


METRIC_NAMES = ("quantity", "extendedprice", "discount", "tax")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    eid = F.concat(F.lit("exp_"), F.col("l_orderkey").cast("string"))
    # the run uuid is computed once per line, before the 4x unpivot
    wide = li.select(eid.alias("experiment_id"), reg.run_uuid(eid).alias("experiment_uuid"),
                     F.col("l_linenumber").alias("step"), F.col("l_shipdate").alias("recorded_at"),
                     *[F.col(f"l_{n}").alias(n) for n in METRIC_NAMES])
    long = wide.unpivot(["experiment_id", "experiment_uuid", "step", "recorded_at"], list(METRIC_NAMES),
                        "metric_name", "metric_value")
    long = long.where(F.col("metric_value").isNotNull())
    return long.select(reg.metric_uuid(F.col("experiment_id"), F.col("metric_name"), F.col("step")).alias("id"),
                       "experiment_uuid", "metric_name", "metric_value", "step", "recorded_at")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lineitem: an evaluation of the order's checkpoint; every second line also refers to the run before."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(F.md5(F.concat_ws(":", F.lit("eval"), key, line)).alias("id"),
                     reg.checkpoint_uuid(F.concat(F.lit("exp_"), key)).alias("checkpoint_id"),
                     F.when(line % 2 == 0, reg.run_uuid(F.concat(F.lit("exp_"), key - 1))).alias("experiment_uuid"))


def inference_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lineitem: every third line is a prompt to the order's checkpoint."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").where(F.col("l_linenumber") % 3 == 0)
    return li.select(F.md5(F.concat_ws(":", F.lit("inf"), "l_orderkey", "l_linenumber")).alias("id"),
                     reg.checkpoint_uuid(F.concat(F.lit("exp_"), F.col("l_orderkey"))).alias("checkpoint_id"))


SUBMISSION_ARRIVAL = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated payloads of one run per order (lineitem), with an explicit arrival order."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate")
    ks = F.col("l_orderkey").cast("string")
    eid = F.concat(F.lit("exp_"), ks)
    ok = F.col("l_returnflag") == "N"
    train_s = F.floor(F.col("l_extendedprice") / 10) / F.lit(10.0)
    return li.select(
        eid.alias("experiment_id"),
        F.when(F.col("l_linestatus") == "O", F.sha1(ks))
         .otherwise(F.sha1(F.concat(ks, F.lit("-"), F.col("l_linenumber").cast("string")))).alias("git_commit"),
        F.lit(None).cast("boolean").alias("git_dirty"),
        _status(F.col("l_returnflag"), "N", "R").alias("status"),
        F.lit(None).cast("string").alias("crash_message"),
        F.when(ok, _bpb(F.col("l_extendedprice"))).alias("val_bpb"),
        train_s.alias("training_seconds"),
        (train_s + F.lit(15.0)).alias("total_seconds"),
        F.lit(None).cast("double").alias("peak_vram_mb"),
        F.lit(None).cast("double").alias("mfu_percent"),
        F.lit(None).cast("long").alias("total_tokens"),
        F.col("l_linenumber").cast("long").alias("num_steps"),
        F.lit(None).cast("long").alias("num_params"),
        F.lit(None).cast("int").alias("depth"),
        F.when(ok, F.concat(F.lit("ckpt/"), eid, F.lit(".pt"))).alias("checkpoint_path"),
        F.lit(None).cast("string").alias("configuration"),
        F.lit(None).cast("string").alias("parent_experiment_id"),
        F.col("l_shipdate").alias("ingest_ts"),
        *SUBMISSION_ARRIVAL,
    )


STEP_CHUNK_MICROS = 7 * 86_400_000_000  # one week of events per (user, chunk)


def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps per user in (ts, event_id) order, numbered without a per-user window: events are cut
    into (user, week) chunks, the chunk table carries the counts and the last timestamp of earlier
    chunks, and rows are numbered inside their chunk. A user with a third of all events is spread
    over many tasks."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    d = e.withColumn("_us", epoch_micros(F.col("ts"))).withColumn("_ch", F.floor(F.col("_us") / F.lit(STEP_CHUNK_MICROS)))
    tot = d.groupBy("user_id", "_ch").agg(F.count(F.lit(1)).alias("_n"), F.max("_us").alias("_mx"))
    before = Window.partitionBy("user_id").orderBy("_ch").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("user_id", "_ch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nb"),
                     F.max("_mx").over(before).alias("_mb"))
    d = d.join(tot, ["user_id", "_ch"], "left")
    w = Window.partitionBy("user_id", "_ch").orderBy("_us", "event_id")
    prev = F.coalesce(F.lag("_us").over(w), F.col("_mb"))
    return d.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("experiment_id"),
        (F.col("_nb") + F.row_number().over(w) - 1).cast("int").alias("step"),
        F.col("value").alias("loss"),
        F.coalesce((F.col("_us") - prev) / F.lit(1e9), F.lit(0.0)).alias("dt"),
        (F.col("event_id") * 1048576).alias("vram_bytes"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("configuration"))
