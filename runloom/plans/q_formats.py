"""Registered queries: display formatting (F1-F14, S11) and configuration arithmetic
(F16-F29, V4), evaluated over whole tables as projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import config as cfg
from runloom.functions import fmt
from runloom.operators import registry as reg
from runloom.plans import standins as st
from runloom.plans.catalog import query, r6
from runloom.plans.oracle_views import with_views as W
from runloom.sources.tables import read_table

DASH = "'—'"


def _dur_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN {DASH} WHEN {c} < 60 THEN printf('%.1f', {c}) || 's' "
            f"ELSE CAST(CAST(floor({c} / 60) AS BIGINT) AS VARCHAR) || 'm ' || "
            f"CAST(CAST(floor(fmod({c}, 60) + 0.5) AS BIGINT) AS VARCHAR) || 's' END")


def _fixed_sql(u: str, dec: int) -> str:
    s = 10 ** dec
    return f"CAST(({u}) // {s} AS VARCHAR) || '.' || lpad(CAST(({u}) % {s} AS VARCHAR), {dec}, '0')"


def _params_sql(n: str) -> str:
    """printf rounds the binary quotient; exact ties, which it takes to even, are pushed up."""
    up = lambda unit, eighth: f"CASE WHEN ({n}) % {unit} % {eighth} = 0 THEN {1 / unit / 10:.12f} ELSE 0 END"
    return (f"CASE WHEN {n} IS NULL THEN {DASH} WHEN {n} >= 1000000 THEN printf('%.2f', ({n}) / 1000000.0::DOUBLE + {up(1000000, 125000)}) || 'M' "
            f"WHEN {n} >= 1000 THEN printf('%.1f', ({n}) / 1000.0::DOUBLE + {up(1000, 250)}) || 'K' ELSE CAST({n} AS VARCHAR) END")


def _short_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {DASH} ELSE substr({c}, 1, 7) END"


def _ts_text_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN {DASH} WHEN TRY_CAST({c} AS TIMESTAMP) IS NULL THEN {c} "
            f"ELSE strftime(TRY_CAST({c} AS TIMESTAMP), '%b %d %Y %H:%M') END")


def _dash(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), {DASH})"


@query("format_runs", "F1-F7 F9", W(["runs"], f"""
SELECT experiment_id,
  CASE WHEN val_bpb IS NULL OR isnan(val_bpb) THEN {DASH} ELSE printf('%.6f', val_bpb) END AS val_bpb_text,
  {_dur_sql('duration_seconds')} AS duration_text,
  {_params_sql('num_params')} AS params_text,
  {_short_sql('git_commit')} || CASE WHEN git_dirty THEN '*' ELSE '' END AS commit_text,
  {_ts_text_sql('CAST(created_at AS VARCHAR)')} AS created_text,
  {_ts_text_sql('crash_message')} AS crash_text,
  'd' || {_dash('depth')} || ' / L' || {_dash('max_seq_len')} || ' / v' || {_dash('vocab_size')} AS config_label,
  CASE WHEN status = 'ok' THEN 'good' WHEN status IN ('crash', 'fail') THEN 'bad' ELSE 'neutral' END AS status_class
FROM runs"""))
def format_runs(spark, d):
    r = st.runs(spark, d)
    return r.select(
        "experiment_id",
        fmt.val_bpb_text(F.col("val_bpb")).alias("val_bpb_text"),
        fmt.duration_text(F.col("duration_seconds")).alias("duration_text"),
        fmt.params_text(F.col("num_params")).alias("params_text"),
        fmt.commit_with_dirty(F.col("git_commit"), F.col("git_dirty")).alias("commit_text"),
        fmt.timestamp_text(F.col("created_at").cast("string")).alias("created_text"),
        fmt.timestamp_text(F.col("crash_message")).alias("crash_text"),
        fmt.config_label(F.col("depth"), F.col("max_seq_len"), F.col("vocab_size")).alias("config_label"),
        fmt.status_class(F.col("status")).alias("status_class"))


@query("format_labels", "F6 F8 F11 F12 F13", W(["payloads", "checkpoints"], f"""
SELECT p.experiment_id,
  'depth=' || {_dash('p.depth')} || ' seq=' || {_dash("TRY_CAST(json_extract_string(p.configuration, '$.max_seq_len') AS INTEGER)")}
    || ' vocab=' || {_dash("TRY_CAST(json_extract_string(p.configuration, '$.vocab_size') AS INTEGER)")}
    || ' window=' || {_dash("json_extract_string(p.configuration, '$.window_pattern')")} AS architecture_label,
  {_short_sql('p.git_commit')} || CASE WHEN p.git_dirty THEN ' (dirty)' ELSE '' END AS commit_detail,
  coalesce(c.checkpoint_path, CASE WHEN p.checkpoint_path <> '' THEN p.checkpoint_path END) AS checkpoint_shown,
  round(p.peak_vram_mb / 1024, 1) AS memory_gb,
  printf('%.6f', coalesce(CASE WHEN p.val_bpb IS NOT NULL AND NOT isnan(p.val_bpb) THEN p.val_bpb END, 0.0)) AS log_val_bpb
FROM payloads p LEFT JOIN checkpoints c ON c.experiment_uuid = md5(p.experiment_id)"""))
def format_labels(spark, d):
    p = st.payloads(spark, d)
    c = st.checkpoints(spark, d).select("experiment_uuid", F.col("checkpoint_path").alias("child_path"))
    conf = F.col("configuration")
    j = p.join(c, reg.run_uuid(F.col("experiment_id")) == F.col("experiment_uuid"), "left")
    return j.select(
        "experiment_id",
        fmt.architecture_label(F.col("depth"), cfg.config_get(conf, "max_seq_len", "int"),
                               cfg.config_get(conf, "vocab_size", "int"),
                               cfg.config_get(conf, "window_pattern", "string")).alias("architecture_label"),
        fmt.commit_with_dirty(F.col("git_commit"), F.col("git_dirty"), detail=True).alias("commit_detail"),
        fmt.checkpoint_to_show(F.col("child_path"), F.col("checkpoint_path")).alias("checkpoint_shown"),
        fmt.memory_gb(F.col("peak_vram_mb")).alias("memory_gb"),
        fmt.log_val_bpb(F.col("val_bpb")).alias("log_val_bpb"))


@query("format_config_json", "F14")
def format_config_json(spark, d):
    """Rows-only: JSON indentation is display text the SQL oracle cannot reproduce."""
    p = st.payloads(spark, d)
    return p.select("experiment_id", fmt.pretty_json(F.col("configuration")).alias("configuration_pretty"))


@query("run_id_roundtrip", "F10", W(["runs"], r"""
SELECT experiment_id, time_id, strftime(parsed, '%Y-%m-%d %H:%M:%S') AS parsed_text,
  parsed = created_at AS roundtrip_ok,
  strftime(TRY_STRPTIME(regexp_extract(experiment_id, '^exp_(\d{8}_\d{6})$', 1), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS key_time
FROM (SELECT experiment_id, created_at, strftime(created_at, 'exp_%Y%m%d_%H%M%S') AS time_id,
        TRY_STRPTIME(regexp_extract(strftime(created_at, 'exp_%Y%m%d_%H%M%S'), '^exp_(\d{8}_\d{6})$', 1), '%Y%m%d_%H%M%S') AS parsed
      FROM runs) s"""))
def run_id_roundtrip(spark, d):
    r = st.runs(spark, d)
    tid = fmt.run_id_from_time(F.col("created_at"))
    parsed = fmt.time_from_run_id(tid)
    f = "yyyy-MM-dd HH:mm:ss"
    return r.select("experiment_id", tid.alias("time_id"), F.date_format(parsed, f).alias("parsed_text"),
                    (parsed == F.col("created_at").cast("timestamp")).alias("roundtrip_ok"),
                    F.date_format(fmt.time_from_run_id(F.col("experiment_id")), f).alias("key_time"))


def results_log_frame(payloads):
    """S11 + W7 + P15 + F12 + F13: the tab-separated results log rows (commit, val_bpb, memory_gb,
    status keep/discard/crash, description). Runs over the hard time limit count as crashes."""
    from runloom.operators.telemetry import overtime_status
    from runloom.schemas import HARD_TIME_LIMIT
    status = overtime_status(F.col("status"), F.col("total_seconds"), HARD_TIME_LIMIT)   # P15
    scored = reg.is_scored(F.col("val_bpb")) & (status == "ok")
    base = payloads.select("experiment_id", F.col("ingest_ts").alias("created_at"),
                           F.when(scored, F.col("val_bpb")).alias("val_bpb"),
                           "git_commit", "peak_vram_mb", "depth",
                           cfg.config_get(F.col("configuration"), "window_pattern", "string").alias("window_pattern"))
    kd = reg.keep_discard(base.select("experiment_id", "created_at", "val_bpb"))
    j = base.join(kd.select("experiment_id", "decision"), "experiment_id")
    return j.select(
        "experiment_id",
        fmt.short_commit(F.col("git_commit")).alias("commit"),
        fmt.log_val_bpb(F.col("val_bpb")).alias("val_bpb"),
        fmt.memory_gb(F.col("peak_vram_mb")).alias("memory_gb"),
        F.col("decision").alias("status"),
        F.concat(F.lit("depth "), F.coalesce(F.col("depth").cast("string"), F.lit("—")), F.lit(" window "),
                 F.coalesce(F.col("window_pattern"), F.lit("—"))).alias("description"))


@query("results_log", "S11 W7 P15 F12 F13", W(["payloads"], f"""
SELECT experiment_id, {_short_sql('git_commit')} AS commit,
  printf('%.6f', coalesce(v, 0.0)) AS val_bpb, round(peak_vram_mb / 1024, 1) AS memory_gb,
  CASE WHEN v IS NULL THEN 'crash' WHEN best_before IS NULL OR v < best_before THEN 'keep' ELSE 'discard' END AS status,
  'depth ' || coalesce(CAST(depth AS VARCHAR), '—') || ' window ' || coalesce(json_extract_string(configuration, '$.window_pattern'), '—') AS description
FROM (SELECT *, min(v) OVER (ORDER BY ingest_ts, experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
      FROM (SELECT *, CASE WHEN val_bpb IS NOT NULL AND NOT isnan(val_bpb) AND status = 'ok' AND total_seconds <= 600
                           THEN val_bpb END AS v FROM payloads) a) b"""))
def results_log(spark, d):
    return results_log_frame(st.payloads(spark, d))


# ---- configuration arithmetic over `part` (p_size as depth) -----------------------------------

def _part(spark, d):
    return read_table(spark, d, "part").select("p_partkey", "p_size")


def _pattern(k):
    return (F.when(k % 4 == 0, F.lit("L")).when(k % 4 == 1, F.lit("SL")).when(k % 4 == 2, F.lit("SSL"))
            .otherwise(F.lit("SSSL")))


PATTERN_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'SL' WHEN 2 THEN 'SSL' ELSE 'SSSL' END"
BATCH_SQL = """
SELECT p_partkey, device_batch, seq_len, total_batch, CAST(device_batch AS BIGINT) * seq_len AS tokens_per_fwdbwd,
  total_batch % (device_batch * seq_len) = 0 AS batch_divisible,
  total_batch // (device_batch * seq_len) AS grad_accum_steps,
  greatest(1, 65536 // (device_batch * seq_len)) AS eval_steps,
  65536 // (device_batch * seq_len) >= 1 AS eval_ok
FROM (SELECT p_partkey, CAST(1 << (p_size % 6 + 2) AS BIGINT) AS device_batch, CAST(128 * (1 + p_partkey % 4) AS BIGINT) AS seq_len,
        CAST(1 << (10 + p_size % 8) AS BIGINT) AS total_batch FROM part) s"""


def _batch(spark, d):
    p = _part(spark, d)
    b = p.select("p_partkey", F.expr("shiftleft(1, p_size % 6 + 2)").cast("long").alias("device_batch"),
                 (128 * (1 + F.col("p_partkey") % 4)).cast("long").alias("seq_len"),
                 F.expr("shiftleft(1, 10 + p_size % 8)").cast("long").alias("total_batch"))
    m = cfg.batch_math(F.col("device_batch"), F.col("seq_len"), F.col("total_batch"))
    return b.select("*", *[v.alias(k) for k, v in m.items()])


@query("batch_math_check", "V4", f"SELECT p_partkey, device_batch, seq_len, total_batch, tokens_per_fwdbwd, batch_divisible, eval_ok FROM ({BATCH_SQL}) x")
def batch_math_check(spark, d):
    return _batch(spark, d).select("p_partkey", "device_batch", "seq_len", "total_batch", "tokens_per_fwdbwd",
                                   "batch_divisible", "eval_ok")


@query("step_counts", "F27", f"SELECT p_partkey, grad_accum_steps, eval_steps FROM ({BATCH_SQL}) x")
def step_counts(spark, d):
    return _batch(spark, d).select("p_partkey", "grad_accum_steps", "eval_steps")


_DIM = "((CAST(p_size AS BIGINT) * 64 + 127) // 128) * 128"
_SIZE_SQL = f"""
SELECT p_partkey, depth, dim AS model_dim, h AS n_heads, ve AS ve_layers, 1024 * dim AS wte, ve * 1024 * (h * 128) AS value_embeds,
  1024 * dim AS lm_head, depth * (10 * dim * dim + 2 * dim * (h * 128)) + ve * 32 * h AS transformer_matrices,
  2 * depth AS scalars,
  1024 * dim + ve * 1024 * (h * 128) + 1024 * dim + depth * (10 * dim * dim + 2 * dim * (h * 128)) + ve * 32 * h + 2 * depth AS total_params,
  {PATTERN_SQL} AS window_pattern
FROM (SELECT p_partkey, p_size, CAST(p_size AS BIGINT) AS depth, {_DIM} AS dim, ({_DIM}) // 128 AS h,
        (CAST(p_size AS BIGINT) + 1) // 2 AS ve FROM part) s"""


def _sizes(spark, d):
    p = _part(spark, d)
    depth = F.col("p_size").cast("long")
    pc = cfg.param_counts(depth, F.lit(1024))
    return p.select("p_partkey", depth.alias("depth"), cfg.model_dim(depth).alias("model_dim"),
                    cfg.n_heads(depth).alias("n_heads"), cfg.n_value_embedding_layers(depth).alias("ve_layers"),
                    pc["wte"].alias("wte"), pc["value_embeds"].alias("value_embeds"), pc["lm_head"].alias("lm_head"),
                    pc["transformer_matrices"].alias("transformer_matrices"), pc["scalars"].alias("scalars"),
                    pc["total"].alias("total_params"), _pattern(F.col("p_partkey")).alias("window_pattern"))


@query("model_size", "F22 F23 F24", f"SELECT * EXCLUDE (window_pattern) FROM ({_SIZE_SQL}) s")
def model_size(spark, d):
    return _sizes(spark, d).drop("window_pattern")


_WIN_SQL = ("list_transform(range(0, depth), lambda i: CASE WHEN i = depth - 1 THEN 256 "
            "WHEN substr(window_pattern, CAST(i % length(window_pattern) AS INTEGER) + 1, 1) = 'L' THEN 256 ELSE 128 END)")


@query("window_sizes", "F25", f"""
SELECT p_partkey, depth, window_pattern, array_to_string({_WIN_SQL}, ',') AS windows FROM ({_SIZE_SQL}) s""")
def window_sizes(spark, d):
    s = _sizes(spark, d)
    w = cfg.window_sizes(F.col("depth"), F.col("window_pattern"), F.lit(256))
    return s.select("p_partkey", "depth", "window_pattern",
                    F.array_join(F.transform(w, lambda x: x.cast("string")), ",").alias("windows"))


@query("flops_per_token", "F26", f"""
SELECT p_partkey, depth, window_pattern,
  6 * (total_params - wte - value_embeds - scalars)
  + CAST(list_sum(list_transform({_WIN_SQL}, lambda w: 12 * n_heads * (model_dim // n_heads) * least(w, 256))) AS BIGINT) AS flops_per_token
FROM ({_SIZE_SQL}) s""")
def flops_per_token(spark, d):
    s = _sizes(spark, d)
    return s.select("p_partkey", "depth", "window_pattern",
                    cfg.flops_per_token(F.col("depth"), F.lit(1024), F.lit(256), F.col("window_pattern"))
                    .alias("flops_per_token"))


@query("lr_multiplier", "F17", """
SELECT p_partkey, round(progress, 6) AS progress,
  round(CASE WHEN progress < 0.0 THEN 1.0 WHEN progress < 0.5 THEN 1.0
       ELSE ((1.0 - progress) / 0.5) * 1.0 + (1 - (1.0 - progress) / 0.5) * 0.0 END, 6) AS lr_multiplier
FROM (SELECT p_partkey, (p_partkey % 101) / CAST(100 AS DOUBLE) AS progress FROM part) s""")
def lr_multiplier(spark, d):
    p = _part(spark, d).select("p_partkey", ((F.col("p_partkey") % 101) / F.lit(100.0)).alias("progress"))
    return p.select("p_partkey", r6("progress").alias("progress"), r6(cfg.lr_multiplier(F.col("progress"))).alias("lr_multiplier"))


@query("schedules", "F18 F19 F29", f"""
SELECT p_partkey, step, round((1 - least(step / CAST(300 AS DOUBLE), 1.0)) * 0.85 + least(step / CAST(300 AS DOUBLE), 1.0) * 0.95, 6) AS momentum,
  round(0.2 * (1.0 - progress), 6) AS weight_decay, round(pow(model_dim / 768.0, -0.5), 6) AS lr_scale
FROM (SELECT p_partkey, p_partkey % 400 AS step, (p_partkey % 101) / CAST(100 AS DOUBLE) AS progress, {_DIM} AS model_dim FROM part) s""")
def schedules(spark, d):
    p = _part(spark, d)
    step = F.col("p_partkey") % 400
    prog = (F.col("p_partkey") % 101) / F.lit(100.0)
    return p.select("p_partkey", step.alias("step"), r6(cfg.muon_momentum(step)).alias("momentum"),
                    r6(cfg.weight_decay(prog)).alias("weight_decay"),
                    r6(cfg.lr_width_scale(cfg.model_dim(F.col("p_size")))).alias("lr_scale"))
