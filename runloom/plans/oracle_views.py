"""The stand-in views of ``runloom.plans.standins`` as DuckDB SQL CTEs (oracle side).

Each entry is ``name -> (dependencies, body)``; :func:`with_views` emits the CTEs a query needs in
dependency order.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _v(name: str, deps: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (deps, body)


_v("payloads", (), """
SELECT 'exp_' || CAST(o_orderkey AS VARCHAR) AS experiment_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN sha1(CAST(o_orderkey AS VARCHAR)) || sha1(CAST(o_orderkey AS VARCHAR))
       ELSE sha1(CAST(o_orderkey AS VARCHAR)) END AS git_commit,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey % 2 = 1 END AS git_dirty,
  CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'fail' ELSE 'crash' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'crash: ' || o_orderpriority END AS crash_message,
  CASE WHEN o_orderstatus = 'O' THEN (CAST(round(o_totalprice * 100) AS BIGINT) % 900000 + 100000) / CAST(1000000 AS DOUBLE) END AS val_bpb,
  floor(o_totalprice / 10) / CAST(10 AS DOUBLE) AS training_seconds,
  floor(o_totalprice / 10) / CAST(10 AS DOUBLE) + CAST(15 AS DOUBLE) AS total_seconds,
  (o_custkey % 64) * CAST(512 AS DOUBLE) AS peak_vram_mb,
  (o_orderkey % 4000) / CAST(100 AS DOUBLE) AS mfu_percent,
  (o_orderkey % 1000) * 16384 AS total_tokens,
  o_orderkey % 1000 AS num_steps,
  CAST(4194440 + (o_orderkey % 97) * 1024 AS BIGINT) AS num_params,
  CAST(2 + o_orderkey % 6 AS INTEGER) AS depth,
  CASE WHEN o_orderstatus = 'O' THEN
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE 'ckpt/exp_' || CAST(o_orderkey AS VARCHAR) || '.pt' END
  END AS checkpoint_path,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE
    '{"max_seq_len": ' || CAST(128 * (1 + o_custkey % 4) AS VARCHAR) || ', "vocab_size": '
    || CAST(512 * (1 + o_orderkey % 4) AS VARCHAR) || ', "window_pattern": "'
    || CASE o_orderkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'SL' ELSE 'SSSL' END || '"}' END AS configuration,
  CASE WHEN o_orderkey % 8 <> 0 THEN 'exp_' || CAST(o_orderkey - 1 AS VARCHAR) END AS parent_experiment_id,
  o_orderdate AS ingest_ts
FROM orders""")

_v("runs", ("payloads",), """
SELECT md5(experiment_id) AS id, experiment_id, status, git_commit, git_dirty, parent_experiment_id,
  ingest_ts - to_microseconds(CAST(round(total_seconds * 1000000) AS BIGINT)) AS started_at,
  ingest_ts AS completed_at, training_seconds AS duration_seconds, val_bpb, num_params, depth,
  TRY_CAST(json_extract_string(configuration, '$.vocab_size') AS INTEGER) AS vocab_size,
  TRY_CAST(json_extract_string(configuration, '$.max_seq_len') AS INTEGER) AS max_seq_len,
  json_extract_string(configuration, '$.window_pattern') AS window_pattern,
  checkpoint_path, configuration, crash_message, ingest_ts AS created_at
FROM payloads""")

_v("checkpoints", ("payloads",), """
SELECT md5('ckpt:' || experiment_id) AS id, md5(experiment_id) AS experiment_uuid, checkpoint_path,
  experiment_id AS meta_experiment_id, git_commit AS meta_git_commit, git_dirty AS meta_git_dirty,
  val_bpb AS meta_val_bpb, depth AS meta_depth, num_params AS meta_num_params,
  TRY_CAST(json_extract_string(configuration, '$.vocab_size') AS INTEGER) AS meta_vocab_size,
  TRY_CAST(json_extract_string(configuration, '$.max_seq_len') AS INTEGER) AS meta_max_seq_len,
  json_extract_string(configuration, '$.window_pattern') AS meta_window_pattern,
  ingest_ts AS created_at
FROM payloads WHERE checkpoint_path IS NOT NULL AND checkpoint_path <> ''""")

_v("evaluations", (), """
SELECT md5(concat_ws(':', 'eval', l_orderkey, l_linenumber)) AS id, md5('ckpt:exp_' || CAST(l_orderkey AS VARCHAR)) AS checkpoint_id,
  CASE WHEN l_linenumber % 2 = 0 THEN md5('exp_' || CAST(l_orderkey - 1 AS VARCHAR)) END AS experiment_uuid FROM lineitem""")

_v("inference_runs", (), """
SELECT md5(concat_ws(':', 'inf', l_orderkey, l_linenumber)) AS id, md5('ckpt:exp_' || CAST(l_orderkey AS VARCHAR)) AS checkpoint_id
FROM lineitem WHERE l_linenumber % 3 = 0""")

_v("metrics_wide_src", (), """
SELECT 'exp_' || CAST(l_orderkey AS VARCHAR) AS experiment_id, l_linenumber AS step, l_shipdate AS recorded_at,
  l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")

_v("metrics", ("metrics_wide_src",), """
SELECT md5(concat_ws(':', experiment_id, metric_name, CAST(step AS VARCHAR))) AS id,
  md5(experiment_id) AS experiment_uuid, metric_name, metric_value, step, recorded_at
FROM (
  SELECT experiment_id, step, recorded_at, 'quantity' AS metric_name, l_quantity AS metric_value FROM metrics_wide_src
  UNION ALL SELECT experiment_id, step, recorded_at, 'extendedprice', l_extendedprice FROM metrics_wide_src
  UNION ALL SELECT experiment_id, step, recorded_at, 'discount', l_discount FROM metrics_wide_src
  UNION ALL SELECT experiment_id, step, recorded_at, 'tax', l_tax FROM metrics_wide_src
) u WHERE metric_value IS NOT NULL""")

_v("submissions", (), """
SELECT 'exp_' || CAST(l_orderkey AS VARCHAR) AS experiment_id,
  CASE WHEN l_linestatus = 'O' THEN sha1(CAST(l_orderkey AS VARCHAR))
       ELSE sha1(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) END AS git_commit,
  CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'R' THEN 'fail' ELSE 'crash' END AS status,
  CASE WHEN l_returnflag = 'N' THEN (CAST(round(l_extendedprice * 100) AS BIGINT) % 900000 + 100000) / CAST(1000000 AS DOUBLE) END AS val_bpb,
  floor(l_extendedprice / 10) / CAST(10 AS DOUBLE) AS training_seconds,
  CAST(l_linenumber AS BIGINT) AS num_steps,
  CASE WHEN l_returnflag = 'N' THEN 'ckpt/exp_' || CAST(l_orderkey AS VARCHAR) || '.pt' END AS checkpoint_path,
  l_shipdate AS ingest_ts, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem""")

_v("first_submissions", ("submissions",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id
    ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM submissions) s
WHERE rn = 1""")

_v("training_steps", (), """
SELECT 'run_' || CAST(user_id AS VARCHAR) AS experiment_id,
  CAST(row_number() OVER w - 1 AS INTEGER) AS step,
  value AS loss,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / CAST(1e9 AS DOUBLE), CAST(0 AS DOUBLE)) AS dt,
  event_id * 1048576 AS vram_bytes
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")

_v("stories", (), "SELECT doc_id, text, lang, source FROM documents")


def with_views(names: tuple[str, ...] | list[str], body: str,
               extra: tuple[tuple[str, str], ...] | list[tuple[str, str]] = (), recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in extra]
    kw = "WITH RECURSIVE" if recursive else "WITH"
    return f"{kw} " + ",\n".join(parts) + f"\n{body}"
