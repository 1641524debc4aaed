"""Registered queries of the run registry (read path, write path in batch, checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import checks
from runloom.operators import registry as reg
from runloom.plans import standins as st
from runloom.plans.catalog import query, r6
from runloom.plans.oracle_views import with_views as W
from runloom.schemas import JSON_FIELDS, RESULT_SCHEMA

SUMMARY = ", ".join(["id", "experiment_id", "status", "git_commit", "git_dirty", "parent_experiment_id", "val_bpb",
                     "duration_seconds", "num_params", "depth", "vocab_size", "max_seq_len", "window_pattern",
                     "checkpoint_path", "created_at"])
SCORED = "val_bpb IS NOT NULL AND NOT isnan(val_bpb)"
BEST_CTE = ("best", f"SELECT experiment_id, val_bpb, num_params, depth FROM runs WHERE {SCORED} "
                    "ORDER BY val_bpb, created_at DESC, experiment_id LIMIT 1")
LATEST_CTE = ("latest", "SELECT experiment_id, created_at, status FROM runs ORDER BY created_at DESC, experiment_id LIMIT 1")


def _overview_sql(src: str) -> str:
    best = ("best", f"SELECT experiment_id, val_bpb FROM {src} WHERE {SCORED} "
                    "ORDER BY val_bpb, created_at DESC, experiment_id LIMIT 1")
    latest = ("latest", f"SELECT experiment_id, created_at FROM {src} ORDER BY created_at DESC, experiment_id LIMIT 1")
    extra = [best, latest]
    if src != "runs":
        extra.insert(0, (src, "SELECT * FROM runs ORDER BY created_at DESC, experiment_id LIMIT 200"))
    return W(["runs"], f"""
SELECT count(*) AS total_runs,
  (SELECT experiment_id FROM best) AS best_experiment_id, (SELECT val_bpb FROM best) AS best_val_bpb,
  (SELECT experiment_id FROM latest) AS latest_experiment_id, (SELECT created_at FROM latest) AS latest_created_at,
  count(*) FILTER (WHERE status = 'ok') AS ok_runs,
  count(*) FILTER (WHERE status IN ('fail', 'crash')) AS rejected_runs,
  round(coalesce(sum(duration_seconds), 0), 6) AS total_training_seconds
FROM {src}""", extra=extra)


def _overview(spark, d, max_rows=None):
    o = reg.overview(st.runs(spark, d), max_rows=max_rows)
    return o.withColumn("total_training_seconds", r6("total_training_seconds"))


@query("overview", "S9 P11 A1-A6", _overview_sql("runs"))
def overview(spark, d):
    return _overview(spark, d)


@query("overview_newest_200", "O3 A6", _overview_sql("runs200"))
def overview_newest_200(spark, d):
    return _overview(spark, d, max_rows=200)


@query("runs_page", "P4 O1 V3", W(["runs"], f"SELECT {SUMMARY} FROM runs ORDER BY created_at DESC, experiment_id LIMIT 50 OFFSET 100"))
def runs_page(spark, d):
    return reg.list_runs(st.runs(spark, d), limit=50, offset=100)


@query("runs_by_status", "P1 P4 O1", W(["runs"], f"SELECT {SUMMARY} FROM runs WHERE status = 'crash' "
                                                 "ORDER BY created_at DESC, experiment_id LIMIT 200 OFFSET 0"))
def runs_by_status(spark, d):
    return reg.list_runs(st.runs(spark, d), limit=200, offset=0, status="crash")


@query("run_count", "A1 P1", W(["runs"], """
SELECT count(*) AS total_all, count(*) FILTER (WHERE status = 'ok') AS total_ok,
  count(*) FILTER (WHERE status = 'fail') AS total_fail, count(*) FILTER (WHERE status = 'crash') AS total_crash,
  count(*) FILTER (WHERE status = 'keep') AS total_keep FROM runs"""))
def run_count(spark, d):
    r = st.runs(spark, d)
    # one scan; each column is the A1 count under the list's status filter ('' = no filter)
    return r.agg(*[F.count_if(F.lit(True) if not s else F.col("status") == s).alias(f"total_{s or 'all'}")
                   for s in ("", "ok", "fail", "crash", "keep")])


@query("run_lookup", "P2 P4", W(["runs"], f"SELECT {SUMMARY} FROM runs WHERE experiment_id = 'exp_7'"))
def run_lookup(spark, d):
    return reg.summary(reg.lookup(st.runs(spark, d), "exp_7"))


@query("run_detail", "P2 P5 J1 J2 A4", W(["runs", "metrics", "checkpoints"], """
SELECT r.experiment_id, r.status, r.val_bpb,
  (SELECT count(*) FROM metrics m WHERE m.experiment_uuid = r.id) AS n_metrics,
  coalesce((SELECT string_agg(metric_name || '@' || CAST(step AS VARCHAR) || '=' || printf('%.2f', metric_value), ';'
             ORDER BY metric_name, step, metric_value) FROM metrics m WHERE m.experiment_uuid = r.id), '') AS metrics_text,
  coalesce((SELECT string_agg(checkpoint_path, ';' ORDER BY created_at, checkpoint_path)
             FROM checkpoints c WHERE c.experiment_uuid = r.id), '') AS checkpoint_paths
FROM runs r WHERE r.experiment_id = (SELECT experiment_id FROM best)""", extra=[BEST_CTE]))
def run_detail(spark, d):
    runs = st.runs(spark, d)
    best = F.broadcast(reg.best_run(runs).select("experiment_id"))  # one row at most
    sel = runs.join(best, "experiment_id", "left_semi")
    det = reg.detail_nested(sel, st.metrics(spark, d), st.checkpoints(spark, d), few=True)
    mtext = F.array_join(F.transform("metrics", lambda m: F.concat(
        m["metric_name"], F.lit("@"), m["step"].cast("string"), F.lit("="), F.format_string("%.2f", m["metric_value"]))), ";")
    ctext = F.array_join(F.transform("checkpoints", lambda c: c["checkpoint_path"]), ";")
    return det.select("experiment_id", "status", "val_bpb", F.size("metrics").cast("long").alias("n_metrics"),
                      mtext.alias("metrics_text"), ctext.alias("checkpoint_paths"))


@query("run_detail_all", "P5 J1 J2 (long form)", W(["runs", "metrics", "checkpoints"], """
SELECT r.experiment_id, r.status, r.val_bpb, r.created_at, 'metric' AS child_kind, m.metric_name AS child_name,
  CAST(m.step AS BIGINT) AS child_step, m.metric_value AS child_value
FROM runs r LEFT JOIN metrics m ON m.experiment_uuid = r.id
UNION ALL
SELECT r.experiment_id, r.status, r.val_bpb, r.created_at, 'checkpoint', c.checkpoint_path, CAST(NULL AS BIGINT),
  CAST(NULL AS DOUBLE)
FROM runs r LEFT JOIN checkpoints c ON c.experiment_uuid = r.id"""))
def run_detail_all(spark, d):
    return reg.detail_long(st.runs(spark, d), st.metrics(spark, d), st.checkpoints(spark, d))


@query("run_child_counts", "A8", W(["runs", "metrics", "checkpoints"], """
SELECT r.experiment_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_metrics, CAST(coalesce(c.n, 0) AS BIGINT) AS n_checkpoints
FROM runs r
LEFT JOIN (SELECT experiment_uuid, count(*) AS n FROM metrics GROUP BY 1) m ON m.experiment_uuid = r.id
LEFT JOIN (SELECT experiment_uuid, count(*) AS n FROM checkpoints GROUP BY 1) c ON c.experiment_uuid = r.id"""))
def run_child_counts(spark, d):
    return reg.child_counts(st.runs(spark, d), st.metrics(spark, d), st.checkpoints(spark, d))


_LONG_SQL = " UNION ALL ".join(
    f"SELECT md5(experiment_id) AS experiment_uuid, '{k}' AS metric_name, round(CAST({k} AS DOUBLE), 6) AS metric_value, "
    f"CAST(num_steps AS INTEGER) AS step FROM payloads WHERE {k} IS NOT NULL"
    for k in ("val_bpb", "training_seconds", "total_seconds", "peak_vram_mb", "mfu_percent", "total_tokens",
              "num_steps", "num_params"))


@query("run_metrics_long", "P9", W(["payloads"], _LONG_SQL))
def run_metrics_long(spark, d):
    m = reg.payload_to_metrics(st.payloads(spark, d), "ingest_ts")
    return m.select("experiment_uuid", "metric_name", r6("metric_value").alias("metric_value"), "step")


@query("run_metrics_wide", "A16", W(["runs", "metrics"], """
SELECT r.experiment_id,
  max(CASE WHEN metric_name = 'quantity' THEN v END) AS quantity,
  max(CASE WHEN metric_name = 'extendedprice' THEN v END) AS extendedprice,
  max(CASE WHEN metric_name = 'discount' THEN v END) AS discount,
  max(CASE WHEN metric_name = 'tax' THEN v END) AS tax
FROM (SELECT experiment_uuid, metric_name, metric_value AS v, row_number() OVER (
        PARTITION BY experiment_uuid, metric_name ORDER BY step DESC, metric_value DESC) AS rn FROM metrics) l
JOIN runs r ON r.id = l.experiment_uuid
WHERE rn = 1 GROUP BY r.experiment_id"""))
def run_metrics_wide(spark, d):
    return reg.metrics_wide(st.metrics(spark, d), st.runs(spark, d), list(st.METRIC_NAMES))


@query("checkpoints_page", "O2 V3", W(["checkpoints"], """
SELECT id, experiment_uuid, checkpoint_path, created_at FROM checkpoints ORDER BY created_at DESC, id LIMIT 50"""))
def checkpoints_page(spark, d):
    c = st.checkpoints(spark, d).select("id", "experiment_uuid", "checkpoint_path", "created_at")
    return reg.page(c, 50, 0, order=[F.col("created_at").desc(), F.col("id")])


_META = ["experiment_id", "git_commit", "git_dirty", "val_bpb", "depth", "num_params", "vocab_size", "max_seq_len",
         "window_pattern"]


@query("checkpoint_metadata", "P10 S12", W(["checkpoints"], "SELECT id, experiment_uuid, checkpoint_path, "
                                        + ", ".join(f"meta_{k}" for k in _META) + ", created_at FROM checkpoints"))
def checkpoint_metadata(spark, d):
    c = st.checkpoints(spark, d)
    return c.select("id", "experiment_uuid", "checkpoint_path", *[F.col(f"metadata.{k}").alias(f"meta_{k}") for k in _META],
                    "created_at")


@query("checkpoint_lookup", "P3", W(["checkpoints"], "SELECT id, experiment_uuid, checkpoint_path, created_at "
                                   "FROM checkpoints WHERE id = md5('ckpt:exp_7')"))
def checkpoint_lookup(spark, d):
    import hashlib
    cid = hashlib.md5(b"ckpt:exp_7").hexdigest()
    c = st.checkpoints(spark, d).select("id", "experiment_uuid", "checkpoint_path", "created_at")
    return reg.lookup_checkpoint(c, cid)


@query("checkpoint_runs", "J8 E3", W(["runs", "checkpoints"], """
SELECT c.id, c.checkpoint_path, c.created_at, r.experiment_id, r.status, r.val_bpb
FROM checkpoints c JOIN runs r ON r.id = c.experiment_uuid"""))
def checkpoint_runs(spark, d):
    j = reg.checkpoint_runs(st.checkpoints(spark, d), st.runs(spark, d))
    return j.select("id", "checkpoint_path", "created_at", "experiment_id", "status", "val_bpb")


@query("best_run", "A4 P11", W(["runs"], "SELECT experiment_id, val_bpb, num_params, depth FROM best", extra=[BEST_CTE]))
def best_run(spark, d):
    return reg.best_run(st.runs(spark, d))


@query("latest_run", "A5", W(["runs"], "SELECT experiment_id, created_at, status FROM latest", extra=[LATEST_CTE]))
def latest_run(spark, d):
    return reg.latest_run(st.runs(spark, d))


@query("status_counts", "A2 P12", W(["runs"], f"""
SELECT count(*) FILTER (WHERE status = 'ok') AS ok_runs, count(*) FILTER (WHERE status IN ('fail', 'crash')) AS rejected_runs,
  count(*) FILTER (WHERE {SCORED}) AS scored_runs, count(*) AS total_runs FROM runs"""))
def status_counts(spark, d):
    return reg.status_counts(st.runs(spark, d))


@query("total_training_time", "A3 F2", W(["runs"], """
SELECT round(t, 6) AS total_training_seconds,
  CASE WHEN t < 60 THEN printf('%.1f', t) || 's'
       ELSE CAST(CAST(floor(t / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(fmod(t, 60) + 0.5) AS BIGINT) AS VARCHAR) || 's'
  END AS total_training_text
FROM (SELECT coalesce(sum(duration_seconds), 0) AS t FROM runs) s"""))
def total_training_time(spark, d):
    from runloom.functions import fmt
    t = reg.total_training_time(st.runs(spark, d))
    return t.select(r6("total_training_seconds").alias("total_training_seconds"),
                    fmt.duration_text(F.col("total_training_seconds")).alias("total_training_text"))


@query("config_extract", "P6", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  TRY_CAST(json_extract_string(props, '$.vocab_size') AS INTEGER) AS vocab_size,
  json_extract_string(props, '$.window_pattern') AS window_pattern FROM events""")
def config_extract(spark, d):
    from runloom.functions.config import config_get
    c = st.configs(spark, d)
    conf = F.col("configuration")
    return c.select("event_id", config_get(conf, "k", "int").alias("k"),
                    config_get(conf, "vocab_size", "int").alias("vocab_size"),
                    config_get(conf, "window_pattern", "string").alias("window_pattern"))


INGEST_TS = "2026-01-01 00:00:00"


@query("run_times", "P7 P8", W(["payloads"], f"""
SELECT experiment_id,
  strftime(TIMESTAMP '{INGEST_TS}' - to_microseconds(CAST(round(total_seconds * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(TIMESTAMP '{INGEST_TS}', '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
  training_seconds AS duration_seconds FROM payloads"""))
def run_times(spark, d):
    p = st.payloads(spark, d).withColumn("ingest_ts", F.lit(INGEST_TS).cast("timestamp_ntz"))
    r = reg.payload_to_runs(p, "ingest_ts")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return r.select("experiment_id", F.date_format("started_at", fmt).alias("started_at"),
                    F.date_format("completed_at", fmt).alias("completed_at"), "duration_seconds")


@query("ingest_first_wins", "W9", W(["first_submissions"], """
SELECT experiment_id, status, val_bpb, git_commit, training_seconds, num_steps FROM first_submissions"""))
def ingest_first_wins(spark, d):
    cols = ["experiment_id", "status", "val_bpb", "git_commit", "training_seconds", "num_steps"]
    f = reg.first_submission(st.submissions(spark, d).select(*cols, *st.SUBMISSION_ARRIVAL), st.SUBMISSION_ARRIVAL)
    return f.select(*cols)


EXISTING_BEFORE = "1998-01-01 00:00:00"


@query("ingest_created_flag", "J3 W9", W(["first_submissions", "runs"], f"""
SELECT f.experiment_id, r.experiment_id IS NULL AS created
FROM first_submissions f
LEFT JOIN (SELECT experiment_id FROM runs WHERE created_at < TIMESTAMP '{EXISTING_BEFORE}') r USING (experiment_id)"""))
def ingest_created_flag(spark, d):
    existing = st.runs(spark, d).where(F.col("created_at") < F.lit(EXISTING_BEFORE).cast("timestamp_ntz"))
    out = reg.ingest(st.submissions(spark, d), existing, st.SUBMISSION_ARRIVAL)
    return out["created"]


#: A wrong value for each result field, by event_id modulo their number.
WRONG_VALUES = {"experiment_id": "5", "git_commit": "17", "git_dirty": '"maybe"', "status": "7", "crash_message": "[1]",
                "val_bpb": '"n/a"', "training_seconds": '"long"', "total_seconds": "{}", "peak_vram_mb": '"?"',
                "mfu_percent": "[]", "total_tokens": "1.5", "num_steps": '"2.5"', "num_params": '"many"', "depth": '"four"',
                "checkpoint_path": "false", "configuration": "3", "parent_experiment_id": "9"}
_WRONG = [f'"{k}": {v}' for k, v in WRONG_VALUES.items()]
_NUMBER = "TRY_CAST(json_extract_string(payload, '$.{c}') AS DOUBLE)"
_FAULTS = {"string": "t <> 'VARCHAR'", "double": _NUMBER + " IS NULL", "bigint": "coalesce(" + _NUMBER + " % 1 <> 0, true)",
           "int": "coalesce(" + _NUMBER + " % 1 <> 0, true)", "boolean": "t <> 'BOOLEAN'"}


def _fault_sql(field) -> str:
    rule = "t <> 'OBJECT'" if field.name in JSON_FIELDS else _FAULTS[field.dataType.simpleString()]
    kind = f"coalesce(json_type(payload, '$.{field.name}'), 'NULL')"
    return f"WHEN {kind} <> 'NULL' AND ({rule.format(c=field.name).replace('t <>', kind + ' <>')}) THEN 'bad_{field.name}'"


QUARANTINE_SQL = f"""
WITH p AS (SELECT event_id, CASE
    WHEN event_type = 'error' THEN '{{"status": "ok", "val_bpb": ' || CAST(value AS VARCHAR) || '}}'
    WHEN event_type = 'signup' THEN '{{"experiment_id": "exp_e' || CAST(event_id AS VARCHAR) || '"}}'
    WHEN event_type = 'click' AND value > 90 THEN 'not json ' || CAST(event_id AS VARCHAR)
    WHEN event_type = 'purchase' AND value > 50 THEN
      '{{' || CASE WHEN event_id % {len(_WRONG)} = 0 THEN '' ELSE '"experiment_id": "exp_e' || CAST(event_id AS VARCHAR) || '", ' END
      || CASE WHEN event_id % {len(_WRONG)} = 3 THEN '' ELSE '"status": "ok", ' END
      || list_extract({[w for w in _WRONG]}, event_id % {len(_WRONG)} + 1) || '}}'
    ELSE '{{"experiment_id": "exp_e' || CAST(event_id AS VARCHAR) || '", "status": "' || CASE WHEN value > 20 THEN 'ok' ELSE 'fail' END
         || '", "val_bpb": ' || CAST(value AS VARCHAR) || ', "depth": 4, "num_steps": 12.0, "git_dirty": false, "configuration": {{"n": 1}}}}' END AS payload FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM p),
v AS (SELECT *, json_extract_string(payload, '$.experiment_id') AS experiment_id, json_extract_string(payload, '$.status') AS status FROM j),
r AS (SELECT *, CASE WHEN payload IS NULL THEN 'not_json' WHEN experiment_id IS NULL THEN 'missing_experiment_id'
       WHEN status IS NULL THEN 'missing_status' {" ".join(_fault_sql(f) for f in RESULT_SCHEMA)} END AS reason FROM v)
"""


def event_payloads(spark, d):
    """(event_id, payload): payload texts from events, some of them with a fault."""
    from runloom.sources.tables import read_table
    e = read_table(spark, d, "events").select("event_id", "event_type", "value")
    key = F.col("event_id").cast("string")
    eid = F.concat(F.lit('"experiment_id": "exp_e'), key, F.lit('"'))
    val = F.col("value").cast("string")
    turn = F.col("event_id") % len(_WRONG)
    wrong = F.element_at(F.array(*[F.lit(w) for w in _WRONG]), (turn + 1).cast("int"))
    payload = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"status": "ok", "val_bpb": '), val, F.lit("}")))
               .when(F.col("event_type") == "signup", F.concat(F.lit("{"), eid, F.lit("}")))
               .when((F.col("event_type") == "click") & (F.col("value") > 90), F.concat(F.lit("not json "), key))
               .when((F.col("event_type") == "purchase") & (F.col("value") > 50),
                     F.concat(F.lit("{"), F.when(turn == 0, F.lit("")).otherwise(F.concat(eid, F.lit(", "))),
                              F.when(turn == 3, F.lit("")).otherwise(F.lit('"status": "ok", ')), wrong, F.lit("}")))
               .otherwise(F.concat(F.lit("{"), eid, F.lit(', "status": "'), F.when(F.col("value") > 20, F.lit("ok")).otherwise(F.lit("fail")),
                                   F.lit('", "val_bpb": '), val, F.lit(', "depth": 4, "num_steps": 12.0, "git_dirty": false, "configuration": {"n": 1}}'))))
    return e.select("event_id", payload.alias("payload"))


@query("payload_quarantine", "V1 V2 P13", QUARANTINE_SQL + f"""
SELECT event_id, experiment_id, reason,
  (reason IS NULL AND status = 'ok' AND {_NUMBER.format(c="val_bpb")} IS NOT NULL) AS accepted
FROM r""")
def payload_quarantine(spark, d):
    v = checks.validate_payload_text(event_payloads(spark, d), "payload")
    return v.select("event_id", "experiment_id", "reason", "accepted")


@query("metric_key_violations", "V5", W(["runs", "metrics"], """
SELECT 'metric_key' AS kind, experiment_uuid || '|' || metric_name || '|' || CAST(step AS VARCHAR) AS key, count(*) AS n
FROM metrics WHERE step IS NOT NULL GROUP BY experiment_uuid, metric_name, step HAVING count(*) > 1
UNION ALL
SELECT 'run_key', experiment_id, count(*) FROM runs GROUP BY experiment_id HAVING count(*) > 1"""))
def metric_key_violations(spark, d):
    return checks.key_violations(st.runs(spark, d), st.metrics(spark, d))


@query("length_violations", "V6", W(["runs"], """
SELECT experiment_id, 'experiment_id' AS column_name, 'too_long' AS violation, CAST(length(experiment_id) AS BIGINT) AS length FROM runs WHERE length(experiment_id) > 128
UNION ALL SELECT experiment_id, 'parent_experiment_id', 'too_long', length(parent_experiment_id) FROM runs WHERE length(parent_experiment_id) > 128
UNION ALL SELECT experiment_id, 'status', 'too_long', length(status) FROM runs WHERE length(status) > 32
UNION ALL SELECT experiment_id, 'git_commit', 'too_long', length(git_commit) FROM runs WHERE length(git_commit) > 64
UNION ALL SELECT experiment_id, 'window_pattern', 'too_long', length(window_pattern) FROM runs WHERE length(window_pattern) > 32
UNION ALL SELECT experiment_id, 'experiment_id', 'null', NULL FROM runs WHERE experiment_id IS NULL
UNION ALL SELECT experiment_id, 'status', 'null', NULL FROM runs WHERE status IS NULL"""))
def length_violations(spark, d):
    return checks.column_violations(st.runs(spark, d), "experiment_id")


@query("orphan_children", "J4", W(["runs", "metrics"], """
SELECT 'metric' AS kind, m.id AS child_key, m.experiment_uuid AS missing_ref
FROM metrics m ANTI JOIN (SELECT id FROM runs WHERE status <> 'crash') r ON r.id = m.experiment_uuid
UNION ALL
SELECT 'parent', c.experiment_id, c.parent_experiment_id
FROM (SELECT * FROM runs WHERE status <> 'crash') c
ANTI JOIN (SELECT experiment_id FROM runs WHERE status <> 'crash') p ON p.experiment_id = c.parent_experiment_id
WHERE c.parent_experiment_id IS NOT NULL"""))
def orphan_children(spark, d):
    registered = st.runs(spark, d).where(F.col("status") != "crash")
    return checks.orphans(registered, st.metrics(spark, d))


@query("parent_link", "J5", W(["runs"], f"""
SELECT c.experiment_id, c.parent_experiment_id, c.val_bpb, p.val_bpb AS parent_val_bpb, p.status AS parent_status,
  CASE WHEN c.val_bpb IS NOT NULL AND NOT isnan(c.val_bpb) AND p.val_bpb IS NOT NULL AND NOT isnan(p.val_bpb)
       THEN c.val_bpb < p.val_bpb END AS improved_on_parent
FROM runs c LEFT JOIN runs p ON p.experiment_id = c.parent_experiment_id"""))
def parent_link(spark, d):
    return reg.parent_link(st.runs(spark, d))


@query("cascade_delete", "J9", W(["runs"], """
SELECT r.experiment_id, CASE WHEN g.experiment_id IS NULL THEN r.parent_experiment_id END AS parent_experiment_id
FROM runs r LEFT JOIN (SELECT experiment_id FROM runs WHERE status = 'crash') g ON g.experiment_id = r.parent_experiment_id
WHERE r.status <> 'crash'"""))
def cascade_delete(spark, d):
    runs = st.runs(spark, d)
    out = reg.cascade_delete(runs, st.metrics(spark, d), st.checkpoints(spark, d),
                             runs.where(F.col("status") == "crash"))
    return out["runs"].select("experiment_id", "parent_experiment_id")


@query("cascade_delete_children", "J9", W(["runs", "metrics"], """
SELECT m.experiment_uuid, m.metric_name, m.step, m.metric_value FROM metrics m
ANTI JOIN (SELECT id FROM runs WHERE status = 'crash') g ON g.id = m.experiment_uuid"""))
def cascade_delete_children(spark, d):
    runs = st.runs(spark, d)
    out = reg.cascade_delete(runs, st.metrics(spark, d), st.checkpoints(spark, d),
                             runs.where(F.col("status") == "crash"))
    return out["metrics"].select("experiment_uuid", "metric_name", "step", "metric_value")


def _tables(spark, d):
    return {"experiments": st.runs(spark, d), "checkpoints": st.checkpoints(spark, d), "evaluations": st.evaluations(spark, d),
            "inference_runs": st.inference_runs(spark, d)}


@query("cascade_delete_grandchildren", "J9", W(["runs", "checkpoints", "evaluations", "inference_runs"], """
SELECT 'evaluations' AS table_name, e.id, CASE WHEN x.id IS NULL THEN e.experiment_uuid END AS experiment_uuid
FROM evaluations e LEFT JOIN (SELECT id FROM runs WHERE depth = 3) x ON x.id = e.experiment_uuid
WHERE e.checkpoint_id NOT IN (SELECT c.id FROM checkpoints c JOIN runs r ON r.id = c.experiment_uuid WHERE r.depth = 3)
UNION ALL SELECT 'inference_runs', i.id, NULL FROM inference_runs i
WHERE i.checkpoint_id NOT IN (SELECT c.id FROM checkpoints c JOIN runs r ON r.id = c.experiment_uuid WHERE r.depth = 3)"""))
def cascade_delete_grandchildren(spark, d):
    """Runs of depth 3 are deleted: what is left of evaluations and inference runs."""
    t = _tables(spark, d)
    kept = reg.delete_propagated(t, t["experiments"].where(F.col("depth") == 3))
    return kept["evaluations"].select(F.lit("evaluations").alias("table_name"), "id", "experiment_uuid").unionByName(
        kept["inference_runs"].select(F.lit("inference_runs").alias("table_name"), "id", F.lit(None).cast("string").alias("experiment_uuid")))


@query("reference_violations", "J4 V5", W(["runs", "checkpoints", "evaluations", "inference_runs"], """
SELECT 'experiments' AS table_name, id, 'parent_experiment_id' AS column_name, parent_experiment_id AS missing_ref FROM runs
WHERE parent_experiment_id IS NOT NULL AND parent_experiment_id NOT IN (SELECT experiment_id FROM runs)
UNION ALL SELECT 'evaluations', id, 'checkpoint_id', checkpoint_id FROM evaluations WHERE checkpoint_id NOT IN (SELECT id FROM checkpoints)
UNION ALL SELECT 'evaluations', id, 'experiment_uuid', experiment_uuid FROM evaluations
WHERE experiment_uuid IS NOT NULL AND experiment_uuid NOT IN (SELECT id FROM runs)
UNION ALL SELECT 'inference_runs', id, 'checkpoint_id', checkpoint_id FROM inference_runs WHERE checkpoint_id NOT IN (SELECT id FROM checkpoints)"""))
def reference_violations(spark, d):
    return reg.reference_violations(_tables(spark, d))


@query("key_set_diff", "J10", """
SELECT coalesce(e.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'missing' ELSE 'unexpected' END AS side
FROM (SELECT DISTINCT 'exp_' || CAST(o_orderkey AS VARCHAR) AS name FROM orders) e
FULL OUTER JOIN (SELECT DISTINCT 'exp_' || CAST(l_orderkey AS VARCHAR) AS name FROM lineitem) p ON e.name = p.name
WHERE e.name IS NULL OR p.name IS NULL""")
def key_set_diff(spark, d):
    from runloom.sources.tables import read_table
    exp = read_table(spark, d, "orders").select(F.concat(F.lit("exp_"), F.col("o_orderkey").cast("string")).alias("name"))
    pres = read_table(spark, d, "lineitem").select(F.concat(F.lit("exp_"), F.col("l_orderkey").cast("string")).alias("name"))
    return reg.key_set_diff(exp, pres, "name")


@query("verify_registration", "J6", W(["first_submissions", "runs", "checkpoints"], """
SELECT experiment_id, 'missing' AS failed_rule FROM j WHERE NOT found
UNION ALL SELECT experiment_id, 'val_bpb' FROM j WHERE found AND val_bpb IS NOT NULL AND val_bpb IS DISTINCT FROM r_bpb
UNION ALL SELECT experiment_id, 'git_commit' FROM j WHERE found AND coalesce(git_commit, '') <> '' AND git_commit IS DISTINCT FROM r_commit
UNION ALL SELECT experiment_id, 'checkpoint' FROM j WHERE found AND coalesce(checkpoint_path, '') <> '' AND NOT has_ckpt""",
    extra=[("j", """SELECT f.experiment_id, f.val_bpb, f.git_commit, f.checkpoint_path, r.val_bpb AS r_bpb,
      r.git_commit AS r_commit, r.id IS NOT NULL AS found, c.experiment_uuid IS NOT NULL AS has_ckpt
    FROM first_submissions f LEFT JOIN runs r USING (experiment_id)
    LEFT JOIN (SELECT DISTINCT experiment_uuid FROM checkpoints) c ON c.experiment_uuid = r.id""")]))
def verify_registration(spark, d):
    # only the compared fields travel through the first-wins aggregate
    cols = ["experiment_id", "val_bpb", "git_commit", "checkpoint_path"]
    src = reg.first_submission(st.submissions(spark, d).select(*cols, *st.SUBMISSION_ARRIVAL), st.SUBMISSION_ARRIVAL)
    return reg.verify_registration(src, st.runs(spark, d), st.checkpoints(spark, d))


@query("keep_discard", "W7", W(["runs"], f"""
SELECT experiment_id, val_bpb, best_before,
  CASE WHEN NOT ({SCORED}) THEN 'crash' WHEN best_before IS NULL OR val_bpb < best_before THEN 'keep' ELSE 'discard' END AS decision
FROM (SELECT experiment_id, val_bpb, min(CASE WHEN {SCORED} THEN val_bpb END) OVER (
        ORDER BY created_at, experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM runs) s"""))
def keep_discard(spark, d):
    return reg.keep_discard(st.runs(spark, d))


@query("lineage_progress", "E2", W(["runs"], """
SELECT experiment_id, root_id, depth, best_val_bpb FROM chain""", recursive=True, extra=[("chain", """
SELECT r.experiment_id, r.experiment_id AS root_id, 0 AS depth,
  CASE WHEN r.val_bpb IS NOT NULL AND NOT isnan(r.val_bpb) THEN r.val_bpb END AS best_val_bpb
FROM runs r LEFT JOIN runs p ON r.parent_experiment_id = p.experiment_id WHERE p.experiment_id IS NULL
UNION ALL
SELECT c.experiment_id, ch.root_id, ch.depth + 1,
  least(ch.best_val_bpb, CASE WHEN c.val_bpb IS NOT NULL AND NOT isnan(c.val_bpb) THEN c.val_bpb END)
FROM chain ch JOIN runs c ON c.parent_experiment_id = ch.experiment_id""")]))
def lineage_progress(spark, d):
    return reg.lineage(st.runs(spark, d))


_CMP_ATTRS = ("status", "val_bpb", "duration_seconds", "num_params", "depth", "vocab_size", "max_seq_len",
              "window_pattern")


def _cmp_sql() -> str:
    def txt(a: str) -> str:
        if a in ("val_bpb", "duration_seconds"):
            return f"printf('%.6f', {a})"
        return f"CAST({a} AS VARCHAR)"
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, (SELECT {txt(a)} FROM runs WHERE experiment_id = (SELECT experiment_id FROM best)) AS best_value, "
        f"(SELECT {txt(a)} FROM runs WHERE experiment_id = (SELECT experiment_id FROM latest)) AS latest_value"
        for a in _CMP_ATTRS)
    return W(["runs"], f"SELECT attribute, best_value, latest_value, best_value IS DISTINCT FROM latest_value AS differs "
                       f"FROM ({rows}) u", extra=[BEST_CTE, LATEST_CTE])


@query("run_compare", "E1", _cmp_sql())
def run_compare(spark, d):
    runs = st.runs(spark, d)
    return reg.compare_runs(runs, {"best": reg.best_run(runs).select("experiment_id"),
                                   "latest": reg.latest_run(runs).select("experiment_id")}, list(_CMP_ATTRS))
