"""Registered queries: step telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import telemetry as tel
from runloom.plans import standins as st
from runloom.plans.catalog import q6, query, r6, sql_q6
from runloom.plans.oracle_views import with_views as W

# operations per token of the reference configuration (depth 4, seq 256, vocab 1024, window L)
FLOPS = 23_593_728

_T = "sum(CASE WHEN step > 10 THEN dt ELSE 0 END) OVER (PARTITION BY experiment_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
TINCL = _T.format(end="CURRENT ROW")
TBEFORE = f"coalesce({_T.format(end='1 PRECEDING')}, 0)"

EMA_CTE = ("e", """
SELECT experiment_id, step, (CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE)) * loss AS s FROM training_steps WHERE step = 0
UNION ALL
SELECT t.experiment_id, t.step, e.s * CAST(0.9 AS DOUBLE) + (CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE)) * t.loss FROM e JOIN training_steps t
  ON t.experiment_id = e.experiment_id AND t.step = e.step + 1""")
EMA_SQL = W(["training_steps"], """
SELECT experiment_id, step, """ + sql_q6("s") + " AS smooth_loss, " + sql_q6("s / (1 - pow(CAST(0.9 AS DOUBLE), step + 1))")
            + " AS ema_loss FROM e", recursive=True, extra=[EMA_CTE])


@query("loss_ema", "W3", EMA_SQL)
def loss_ema(spark, d):
    e = tel.loss_ema(st.training_steps(spark, d))
    return e.select("experiment_id", "step", q6("smooth_loss").alias("smooth_loss"), q6("ema_loss").alias("ema_loss"))


@query("training_progress", "W4", W(["training_steps"], f"""
SELECT experiment_id, step, round(t_incl, 6) AS training_time, round(least(t_before / 300.0, 1.0), 6) AS progress,
  round(100.0 * least(t_before / 300.0, 1.0), 6) AS pct_done, round(greatest(0.0, 300.0 - t_incl), 6) AS remaining
FROM (SELECT experiment_id, step, {TINCL} AS t_incl, {TBEFORE} AS t_before FROM training_steps) s"""))
def training_progress(spark, d):
    p = tel.training_progress(st.training_steps(spark, d))
    return p.select("experiment_id", "step", *[r6(c).alias(c) for c in ("training_time", "progress", "pct_done", "remaining")])


STOP_CTE = ("stops", f"""
SELECT experiment_id, fail_step, time_step,
  CASE WHEN fail_step IS NOT NULL AND (time_step IS NULL OR fail_step <= time_step) THEN 'fail'
       WHEN time_step IS NOT NULL THEN 'time' ELSE 'end' END AS stop_reason,
  CAST(CASE WHEN fail_step IS NOT NULL AND (time_step IS NULL OR fail_step <= time_step) THEN fail_step
       WHEN time_step IS NOT NULL THEN time_step + 1 ELSE max_step + 1 END AS BIGINT) AS num_steps
FROM (SELECT experiment_id, min(CASE WHEN isnan(loss) OR loss > 100 THEN step END) AS fail_step,
        min(CASE WHEN step >= 10 AND t_incl >= 300 THEN step END) AS time_step, max(step) AS max_step
      FROM (SELECT *, {TINCL} AS t_incl FROM training_steps) t GROUP BY experiment_id) a""")


@query("run_stop_step", "W8 P14", W(["training_steps"], "SELECT * FROM stops", extra=[STOP_CTE]))
def run_stop_step(spark, d):
    return tel.stop_steps(st.training_steps(spark, d))


@query("run_summary", "A11-A15 P14", W(["training_steps"], f"""
SELECT s.experiment_id, CASE WHEN s.stop_reason = 'fail' THEN 'fail' ELSE 'ok' END AS status, s.num_steps,
  round(coalesce(a.t, 0), 6) AS training_seconds, s.num_steps * 16384 AS total_tokens,
  round(a.peak / 1048576.0, 6) AS peak_vram_mb,
  round(CASE WHEN coalesce(a.t, 0) > 0 THEN 100.0 * {FLOPS} * 16384 * greatest(s.num_steps - 10, 0) / a.t / 989.5e12 ELSE 0.0 END, 6) AS mfu_percent
FROM stops s LEFT JOIN (
  SELECT ts.experiment_id, sum(CASE WHEN ts.step > 10 THEN ts.dt END) AS t, max(ts.vram_bytes) AS peak
  FROM training_steps ts JOIN stops s2 ON s2.experiment_id = ts.experiment_id WHERE ts.step < s2.num_steps
  GROUP BY ts.experiment_id) a ON a.experiment_id = s.experiment_id""", extra=[STOP_CTE]))
def run_summary(spark, d):
    s = tel.run_summary(st.training_steps(spark, d), FLOPS)
    return s.select("experiment_id", "status", "num_steps", r6("training_seconds").alias("training_seconds"),
                    "total_tokens", r6("peak_vram_mb").alias("peak_vram_mb"), r6("mfu_percent").alias("mfu_percent"))


@query("throughput", "F15 F16 F28", W(["training_steps"], f"""
SELECT experiment_id, step, CASE WHEN dt > 0 THEN CAST(floor(16384 / dt) AS BIGINT) END AS tok_per_sec,
  round(CASE WHEN dt > 0 THEN 100.0 * {FLOPS} * 16384 / dt / 989.5e12 END, 6) AS mfu,
  round((step + 1) * 16384.0 / 1e6, 6) AS tokens_m
FROM training_steps"""))
def throughput(spark, d):
    t = tel.throughput(st.training_steps(spark, d), FLOPS)
    return t.select("experiment_id", "step", "tok_per_sec", r6("mfu").alias("mfu"), r6("tokens_m").alias("tokens_m"))


@query("blowup_steps", "P14 M5 (batch twin)", W(["training_steps"], """
SELECT experiment_id, step, loss FROM training_steps WHERE isnan(loss) OR loss > 100"""))
def blowup_steps(spark, d):
    s = st.training_steps(spark, d)
    return s.where(tel.blowup(F.col("loss"))).select("experiment_id", "step", "loss")
