"""Step telemetry: smoothed loss, training time, progress, stop rules and the run summary
(W3, W4, W8, P14, P15, A11-A15, F15, F16, F28) over a table
``training_steps(experiment_id, step, loss, dt, vram_bytes)``.

Per-run order matters, but no run is ever sorted in one task: running sums go through
:func:`runloom.operators.ordered.prefix_agg` (chunks of steps) and the EMA through a tree of
affine maps, one for each chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions import config as cfg
from runloom.operators.ordered import prefix_agg
from runloom.schemas import (EMA_BETA, LOSS_BLOWUP, PEAK_FLOPS, TIME_BUDGET, TOTAL_BATCH_SIZE,
                             WARMUP_STEPS_EXCLUDED)

def blowup(loss) -> F.Column:
    """NaN or above 100."""
    return F.isnan(loss) | (loss > LOSS_BLOWUP)


def counted_dt():
    """Only steps after the first ten count toward training time."""
    return F.when(F.col("step") > WARMUP_STEPS_EXCLUDED, F.col("dt"))


def loss_ema(steps: DataFrame, beta: float = EMA_BETA, width: int = 64, fan: int = 64) -> DataFrame:
    """s = beta*s + (1-beta)*loss from s = 0, debiased by 1 - beta^(step+1). Inside a chunk of steps the recursion
    is folded step by step; it is linear, so a whole chunk is one affine map, given by its length and its fold from 0.
    Maps of ``fan`` neighbouring chunks are composed into one, level by level, and the value before each chunk comes
    down the same tree: no row holds more than ``width`` losses or ``fan`` maps, no history is dropped and a NaN stays."""
    key = ["experiment_id", "_ch"]
    order = Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = steps.select("experiment_id", "step", "loss").withColumn("_ch", F.floor(F.col("step") / width))

    def fold(losses, start):
        return F.aggregate(losses, start, lambda acc, x: acc * F.lit(beta) + F.lit(1.0 - beta) * x)

    chunks = d.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("all"))
    chunks = chunks.select(*key, F.size("all").alias("n"), fold(F.col("all.loss"), F.lit(0.0)).alias("tail"))
    top = (steps.agg(F.max("step")).first()[0] or 0) // width
    d = d.withColumn("_seen", F.collect_list("loss").over(order)).join(_before(chunks, top, beta, fan), key)
    out = d.select("experiment_id", "step", "loss", fold(F.col("_seen"), F.col("_before")).alias("smooth_loss"))
    return out.withColumn("ema_loss", F.col("smooth_loss") / (F.lit(1.0) - F.pow(F.lit(beta), F.col("step") + 1)))


def _before(maps: DataFrame, top: int, beta: float, fan: int) -> DataFrame:
    """(experiment_id, _ch, n, tail), _ch up to ``top`` -> experiment_id, _ch, _before: the value that the maps before a
    map lead to from 0."""
    def compose(found, start):
        return F.aggregate(found, start, lambda acc, c: acc * F.pow(F.lit(beta), c["n"]) + c["tail"])

    group = ["experiment_id", "_up"]
    maps = maps.withColumn("_up", F.floor(F.col("_ch") / fan))
    earlier = F.collect_list(F.struct("n", "tail")).over(Window.partitionBy(*group).orderBy("_ch").rowsBetween(Window.unboundedPreceding, -1))
    own = maps.withColumn("_earlier", earlier)
    if top < fan:
        start = F.lit(0.0)
    else:
        above = maps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_ch", "n", "tail"))).alias("all"))
        above = above.select("experiment_id", F.col("_up").alias("_ch"), F.aggregate("all", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("n"),
                             compose(F.col("all"), F.lit(0.0)).alias("tail"))
        own = own.join(_before(above, top // fan, beta, fan).select("experiment_id", F.col("_ch").alias("_up"), F.col("_before").alias("_start")), group)
        start = F.col("_start")
    return own.select("experiment_id", "_ch", compose(F.col("_earlier"), start).alias("_before"))


def with_training_time(steps: DataFrame, width: int = 4096) -> DataFrame:
    """W4 running training time: ``t_incl`` through this step, ``t_before`` before it."""
    d = prefix_agg(steps, order_col="step", partition_cols=["experiment_id"], value=counted_dt(), how="sum",
                   out="t_incl", inclusive=True, width=width)
    return d.withColumn("t_before", F.col("t_incl") - F.coalesce(counted_dt(), F.lit(0.0)))


def training_progress(steps: DataFrame, budget: float = TIME_BUDGET) -> DataFrame:
    """Progress uses the time *before* the step; remaining uses the time after it."""
    d = with_training_time(steps)
    progress = F.least(F.col("t_before") / F.lit(float(budget)), F.lit(1.0))
    return d.select("experiment_id", "step", F.col("t_incl").alias("training_time"), progress.alias("progress"),
                    (F.lit(100.0) * progress).alias("pct_done"),
                    F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("t_incl")).alias("remaining"))


def stop_steps(steps: DataFrame, budget: float = TIME_BUDGET) -> DataFrame:
    """W8 + P14: the first blow-up step (the run fails there, that step is not counted) or the first
    step from step 10 on whose running time reaches the budget (counted, then stop); a plain
    aggregate per run, partially aggregated before the shuffle."""
    return _stops_from(with_training_time(steps), budget)


def _stops_from(d: DataFrame, budget: float) -> DataFrame:
    agg = d.groupBy("experiment_id").agg(
        F.min(F.when(blowup(F.col("loss")), F.col("step"))).alias("fail_step"),
        F.min(F.when((F.col("step") >= WARMUP_STEPS_EXCLUDED) & (F.col("t_incl") >= F.lit(float(budget))), F.col("step")))
        .alias("time_step"),
        F.max("step").alias("max_step"))
    failed = F.col("fail_step").isNotNull() & (F.col("time_step").isNull() | (F.col("fail_step") <= F.col("time_step")))
    reason = F.when(failed, F.lit("fail")).when(F.col("time_step").isNotNull(), F.lit("time")).otherwise(F.lit("end"))
    n = (F.when(failed, F.col("fail_step")).when(F.col("time_step").isNotNull(), F.col("time_step") + 1)
         .otherwise(F.col("max_step") + 1))
    return agg.select("experiment_id", "fail_step", "time_step", reason.alias("stop_reason"), n.cast("long").alias("num_steps"))


def run_summary(steps: DataFrame, flops_per_token: int, budget: float = TIME_BUDGET,
                batch: int = TOTAL_BATCH_SIZE) -> DataFrame:
    """The printed summary per run from its executed steps (step < num_steps). The step
    table with running time is built once and feeds both the stop rule and the summary."""
    timed = with_training_time(steps)
    stops = _stops_from(timed, budget)
    d = timed.join(stops.select("experiment_id", "num_steps", "stop_reason"), "experiment_id")
    d = d.where(F.col("step") < F.col("num_steps"))
    agg = d.groupBy("experiment_id", "num_steps", "stop_reason").agg(
        F.coalesce(F.sum(counted_dt()), F.lit(0.0)).alias("training_seconds"),
        F.max("vram_bytes").alias("_peak"))
    t = F.col("training_seconds")
    mfu = F.when(t > 0, F.lit(100.0) * F.lit(float(flops_per_token)) * F.lit(float(batch))
                 * F.greatest(F.col("num_steps") - WARMUP_STEPS_EXCLUDED, F.lit(0)) / t / F.lit(PEAK_FLOPS)).otherwise(F.lit(0.0))
    # runs that stop at their first step have no executed rows: they still get a summary
    base = stops.select("experiment_id", "num_steps", "stop_reason")
    out = base.join(agg.drop("num_steps", "stop_reason"), "experiment_id", "left")
    return out.select(
        "experiment_id",
        F.when(F.col("stop_reason") == "fail", F.lit("fail")).otherwise(F.lit("ok")).alias("status"),
        "num_steps",
        F.coalesce(t, F.lit(0.0)).alias("training_seconds"),
        (F.col("num_steps") * batch).alias("total_tokens"),
        (F.col("_peak") / F.lit(1048576.0)).alias("peak_vram_mb"),
        F.coalesce(mfu, F.lit(0.0)).alias("mfu_percent"))


def throughput(steps: DataFrame, flops_per_token: int, batch: int = TOTAL_BATCH_SIZE) -> DataFrame:
    """F15, F16, F28 per step."""
    return steps.select("experiment_id", "step",
                        cfg.tokens_per_second(F.col("dt"), batch).alias("tok_per_sec"),
                        cfg.mfu_percent(F.lit(flops_per_token), F.col("dt"), batch).alias("mfu"),
                        ((F.col("step") + 1) * F.lit(float(batch)) / F.lit(1e6)).alias("tokens_m"))


def overtime_status(status, total_seconds, limit: float = 600.0):
    """A run over the hard limit counts as a crash."""
    return F.when(total_seconds > limit, F.lit("crash")).otherwise(status)
