"""Run registry: ingest result documents, explode them into runs / metrics / checkpoints, and
answer list, detail, summary and verification questions over those tables.

All functions take and return DataFrames; nothing is collected except the one-row page totals
callers may ask for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import config as cfg
from runloom.schemas import (PAGE_MAX, PAGE_MIN, REJECTED_STATUSES, STATUS_OK, SUMMARY_COLUMNS,
                             SUMMARY_METRIC_KEYS)

# ---------------------------------------------------------------------------------------------
# deterministic ids (random ids would break retries of a stream)
# ---------------------------------------------------------------------------------------------

def run_uuid(experiment_id: Column) -> Column:
    return F.md5(experiment_id)


def checkpoint_uuid(experiment_id: Column) -> Column:
    return F.md5(F.concat(F.lit("ckpt:"), experiment_id))


def metric_uuid(experiment_id: Column, name: Column, step: Column) -> Column:
    return F.md5(F.concat_ws(":", experiment_id, name, F.coalesce(step.cast("string"), F.lit(""))))


# ---------------------------------------------------------------------------------------------
# write path: payload -> rows  (P6, P7, P8, P9, P10, S12)
# ---------------------------------------------------------------------------------------------

def minus_seconds(ts: Column, seconds: Column) -> Column:
    """ts - seconds, exact to the microsecond."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def payload_to_runs(payloads: DataFrame, ingest_ts: Column | str = "ingest_ts") -> DataFrame:
    """One registry row per payload. ``completed_at`` = ingest time, ``started_at`` = completed
    minus total seconds, ``duration_seconds`` is the *training* time, config keys extracted."""
    ts = F.col(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    conf = F.col("configuration")
    return payloads.select(
        run_uuid(F.col("experiment_id")).alias("id"),
        "experiment_id", "status", "git_commit", "git_dirty", "parent_experiment_id",
        minus_seconds(ts, F.col("total_seconds")).alias("started_at"),
        ts.alias("completed_at"),
        F.col("training_seconds").alias("duration_seconds"),
        "val_bpb", "num_params", "depth",
        cfg.config_get(conf, "vocab_size", "int").alias("vocab_size"),
        cfg.config_get(conf, "max_seq_len", "int").alias("max_seq_len"),
        cfg.config_get(conf, "window_pattern", "string").alias("window_pattern"),
        "checkpoint_path", "configuration", "crash_message",
        ts.alias("created_at"),
    )


def payload_to_metrics(payloads: DataFrame, recorded_ts: Column | str = "ingest_ts") -> DataFrame:
    """The eight summary values as long rows; NULL skipped, 0 kept, all at step = num_steps."""
    ts = F.col(recorded_ts) if isinstance(recorded_ts, str) else recorded_ts
    # the run's uuid is computed once a payload, before the unpivot
    wide = payloads.select("experiment_id", run_uuid(F.col("experiment_id")).alias("experiment_uuid"), F.col("num_steps").cast("int").alias("step"),
                           ts.alias("recorded_at"), *[F.col(k).cast("double").alias(k) for k in SUMMARY_METRIC_KEYS])
    long = wide.unpivot(["experiment_id", "experiment_uuid", "step", "recorded_at"], list(SUMMARY_METRIC_KEYS),
                        "metric_name", "metric_value").where(F.col("metric_value").isNotNull())
    return long.select(
        metric_uuid(F.col("experiment_id"), F.col("metric_name"), F.col("step")).alias("id"),
        "experiment_uuid", "metric_name", "metric_value", "step", "recorded_at")


def checkpoint_metadata(payloads: DataFrame) -> Column:
    conf = F.col("configuration")
    return F.struct(
        F.col("experiment_id"), F.col("git_commit"), F.col("git_dirty"), F.col("val_bpb"), F.col("depth"),
        F.col("num_params"),
        cfg.config_get(conf, "vocab_size", "int").alias("vocab_size"),
        cfg.config_get(conf, "max_seq_len", "int").alias("max_seq_len"),
        cfg.config_get(conf, "window_pattern", "string").alias("window_pattern"),
    )


def payload_to_checkpoints(payloads: DataFrame, created_ts: Column | str = "ingest_ts") -> DataFrame:
    """P10 + S12: a checkpoint row only for a non-empty path, carrying the 9-key metadata."""
    ts = F.col(created_ts) if isinstance(created_ts, str) else created_ts
    return (payloads.where(F.col("checkpoint_path").isNotNull() & (F.col("checkpoint_path") != ""))
            .select(checkpoint_uuid(F.col("experiment_id")).alias("id"),
                    run_uuid(F.col("experiment_id")).alias("experiment_uuid"),
                    "checkpoint_path", checkpoint_metadata(payloads).alias("metadata"),
                    ts.alias("created_at")))


# ---------------------------------------------------------------------------------------------
# first write wins
# ---------------------------------------------------------------------------------------------

def first_submission(payloads: DataFrame, arrival: list[str], key: str = "experiment_id") -> DataFrame:
    """The earliest payload per key in arrival order. ``min_by`` over a struct is a plain
    aggregate, so it is partially aggregated before the shuffle: a key holding a third of all
    submissions costs one partial row per map task, not one giant sort."""
    others = [c for c in payloads.columns if c != key]
    order_key = F.struct(*[F.col(c) for c in arrival])
    picked = payloads.groupBy(key).agg(F.min_by(F.struct(*others), order_key).alias("_p"))
    return picked.select(key, *[F.col("_p")[c].alias(c) for c in others])


def ingest(payloads: DataFrame, existing_runs: DataFrame | None, arrival: list[str],
           ingest_ts: Column | str = "ingest_ts") -> dict[str, DataFrame]:
    """Register each experiment once. Later payloads for a known id are ignored.

    Returns new ``runs``, ``metrics``, ``checkpoints`` and ``created`` (one row per submitted id with
    the ``created`` flag: True when this batch registered it). ``existing_runs`` needs only the keys that the batch may
    have; which side of the joins is broadcast is left to the planner's size check."""
    first = first_submission(payloads, arrival)
    if existing_runs is not None:
        known = existing_runs.select("experiment_id").join(first.select("experiment_id"), "experiment_id", "left_semi").distinct()
        new = first.join(known, "experiment_id", "left_anti")
        created = (first.select("experiment_id")
                   .join(known.withColumn("_hit", F.lit(True)), "experiment_id", "left")
                   .select("experiment_id", F.col("_hit").isNull().alias("created")))
    else:
        new = first
        created = first.select("experiment_id", F.lit(True).alias("created"))
    return {
        "runs": payload_to_runs(new, ingest_ts),
        "metrics": payload_to_metrics(new, ingest_ts),
        "checkpoints": payload_to_checkpoints(new, ingest_ts),
        "created": created,
        "accepted": new,
    }


# ---------------------------------------------------------------------------------------------
# read path
# ---------------------------------------------------------------------------------------------

def check_page(limit: int, offset: int) -> None:
    """V3: page bounds, checked before anything is planned."""
    if not isinstance(limit, int) or not (PAGE_MIN <= limit <= PAGE_MAX):
        raise ValueError(f"limit must be between {PAGE_MIN} and {PAGE_MAX}, got {limit!r}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError(f"offset must be >= 0, got {offset!r}")


def filter_status(runs: DataFrame, status: str | None) -> DataFrame:
    """None or empty string means no filter."""
    return runs.where(F.col("status") == status) if status else runs


def summary(runs: DataFrame) -> DataFrame:
    """The 15-column summary projection."""
    return runs.select(*SUMMARY_COLUMNS)


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("experiment_id").asc()]


def page(df: DataFrame, limit: int, offset: int, order: list[Column] | None = None) -> DataFrame:
    """O1 / O2: newest first with a stable tie-break, then offset + limit. Planned as a
    TakeOrderedAndProject: each task keeps only its top (offset + limit) rows."""
    check_page(limit, offset)
    return df.orderBy(*(order or newest_first())).offset(offset).limit(limit)


def list_runs(runs: DataFrame, limit: int = 50, offset: int = 0, status: str | None = None) -> DataFrame:
    return page(summary(filter_status(runs, status)), limit, offset)


def count_runs(runs: DataFrame, status: str | None = None) -> DataFrame:
    """A1: the count under the same filter as the page; a one-row frame (0 when empty)."""
    return filter_status(runs, status).agg(F.count(F.lit(1)).alias("total"))


def lookup(runs: DataFrame, experiment_id: str) -> DataFrame:
    """Point lookup by business key; an empty result stands for 'not found'."""
    return runs.where(F.col("experiment_id") == F.lit(experiment_id))


def lookup_checkpoint(checkpoints: DataFrame, checkpoint_id: str) -> DataFrame:
    """P3."""
    return checkpoints.where(F.col("id") == F.lit(checkpoint_id))


def detail_nested(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame, few: bool = False) -> DataFrame:
    """P5 + J1 + J2 for a *selected* set of runs (filter ``runs`` first, e.g. with :func:`lookup`):
    children are semi-joined to the selection, aggregated per run, then left-joined, one relation
    at a time so metrics never multiply with checkpoints. Empty arrays, not NULL. ``few``: the selection is known to be a few
    runs; their ids and children are broadcast, so that no child table is shuffled whole."""
    small = F.broadcast if few else lambda df: df
    ids = small(runs.select(F.col("id").alias("experiment_uuid")).distinct())
    m = (metrics.join(ids, "experiment_uuid", "left_semi")
         .groupBy("experiment_uuid")
         .agg(F.array_sort(F.collect_list(F.struct("metric_name", "step", "metric_value", "id", "recorded_at")))
              .alias("metrics")))
    c = (checkpoints.join(ids, "experiment_uuid", "left_semi")
         .groupBy("experiment_uuid")
         .agg(F.array_sort(F.collect_list(F.struct("created_at", "checkpoint_path", "id", "metadata")))
              .alias("checkpoints")))
    out = (runs.join(small(m), runs["id"] == m["experiment_uuid"], "left").drop("experiment_uuid")
           .join(small(c), runs["id"] == c["experiment_uuid"], "left").drop("experiment_uuid"))
    empty_m = F.array().cast(m.schema["metrics"].dataType)
    empty_c = F.array().cast(c.schema["checkpoints"].dataType)
    return (out.withColumn("metrics", F.coalesce("metrics", empty_m))
               .withColumn("checkpoints", F.coalesce("checkpoints", empty_c)))


def detail_long(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """P5 + J1 + J2 over the whole registry, in long form: one row per (run, child); a run without
    children of a kind still appears once with NULL child columns. No per-run collection, so a run
    with a third of all metric rows is just a skewed equi-join (AQE splits it)."""
    base = runs.select(F.col("id").alias("run_uuid"), "experiment_id", "status", "val_bpb", "created_at")
    m = metrics.select(F.col("experiment_uuid").alias("run_uuid"), F.lit("metric").alias("child_kind"),
                       F.col("metric_name").alias("child_name"), F.col("step").cast("long").alias("child_step"),
                       F.col("metric_value").alias("child_value"))
    c = checkpoints.select(F.col("experiment_uuid").alias("run_uuid"), F.lit("checkpoint").alias("child_kind"),
                           F.col("checkpoint_path").alias("child_name"), F.lit(None).cast("long").alias("child_step"),
                           F.lit(None).cast("double").alias("child_value"))
    # children drive the join (right outer keeps runs without children): the run side is the one a
    # planner may broadcast, the large child side is streamed
    rm = m.join(base, "run_uuid", "right").withColumn("child_kind", F.coalesce("child_kind", F.lit("metric")))
    rc = c.join(base, "run_uuid", "right").withColumn("child_kind", F.coalesce("child_kind", F.lit("checkpoint")))
    return rm.unionByName(rc).drop("run_uuid")


def child_counts(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Metric and checkpoint counts per run, 0 when none (children counted before the join)."""
    mc = metrics.groupBy("experiment_uuid").agg(F.count(F.lit(1)).alias("n_metrics"))
    cc = checkpoints.groupBy("experiment_uuid").agg(F.count(F.lit(1)).alias("n_checkpoints"))
    r = runs.select("id", "experiment_id")
    out = (r.join(mc, r["id"] == mc["experiment_uuid"], "left").drop("experiment_uuid")
           .join(cc, r["id"] == cc["experiment_uuid"], "left").drop("experiment_uuid"))
    return out.select("experiment_id", F.coalesce("n_metrics", F.lit(0)).cast("long").alias("n_metrics"),
                      F.coalesce("n_checkpoints", F.lit(0)).cast("long").alias("n_checkpoints"))


def metrics_wide(metrics: DataFrame, runs: DataFrame, names: list[str]) -> DataFrame:
    """Latest value per (run, metric) as one column per name. 'Latest' = highest step, then
    highest value. Names are fixed, so the pivot needs no extra job to discover them."""
    # one aggregation per run (a pivot over fixed names without a second shuffle)
    def latest(n: str) -> Column:
        hit = F.col("metric_name") == n
        return F.max_by(F.when(hit, F.col("metric_value")), F.when(hit, F.struct("step", "metric_value"))).alias(n)
    wide = metrics.groupBy("experiment_uuid").agg(*[latest(n) for n in names])
    r = runs.select("id", "experiment_id")
    return (r.join(wide, r["id"] == wide["experiment_uuid"], "inner")
            .select("experiment_id", *[F.col(n).alias(n) for n in names]))


def is_scored(c: Column) -> Column:
    """scored = not NULL and not NaN."""
    return c.isNotNull() & ~F.isnan(c)


def best_key() -> Column:
    """A4 order: lowest val_bpb; ties go to the newest run, then the smaller id."""
    return F.struct(F.col("val_bpb"), (-cfg.epoch_micros(F.col("created_at"))),
                    F.col("experiment_id"))


def latest_key() -> Column:
    """A5 order: newest created_at, then the smaller id (same as the list order)."""
    return F.struct((-cfg.epoch_micros(F.col("created_at"))), F.col("experiment_id"))


def overview(runs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One global aggregate (partial per task, then one final row): totals, best, latest,
    status counts and total training time. ``max_rows=200`` reproduces the dashboard's window
    of the newest 200 runs (O3)."""
    src = runs
    if max_rows is not None:
        src = runs.orderBy(*newest_first()).limit(max_rows)
    scored = is_scored(F.col("val_bpb"))
    best = F.min_by(F.when(scored, F.struct("experiment_id", "val_bpb", "num_params", "depth")),
                    F.when(scored, best_key()))
    latest = F.min_by(F.struct("experiment_id", "created_at"), latest_key())
    agg = src.agg(
        F.count(F.lit(1)).alias("total_runs"),
        best.alias("_best"),
        latest.alias("_latest"),
        F.count_if(F.col("status") == STATUS_OK).alias("ok_runs"),
        F.count_if(F.col("status").isin(*REJECTED_STATUSES)).alias("rejected_runs"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_training_seconds"),
    )
    return agg.select(
        "total_runs",
        F.col("_best.experiment_id").alias("best_experiment_id"),
        F.col("_best.val_bpb").alias("best_val_bpb"),
        F.col("_latest.experiment_id").alias("latest_experiment_id"),
        F.col("_latest.created_at").alias("latest_created_at"),
        "ok_runs", "rejected_runs", "total_training_seconds")


def best_run(runs: DataFrame) -> DataFrame:
    scored = is_scored(F.col("val_bpb"))
    return (runs.where(scored)
            .agg(F.min_by(F.struct("experiment_id", "val_bpb", "num_params", "depth"), best_key()).alias("b"))
            .where(F.col("b").isNotNull()).select("b.*"))


def latest_run(runs: DataFrame) -> DataFrame:
    return (runs.agg(F.min_by(F.struct("experiment_id", "created_at", "status"), latest_key()).alias("l"))
            .where(F.col("l").isNotNull()).select("l.*"))


def status_counts(runs: DataFrame) -> DataFrame:
    """A2 + P12: conditional counts."""
    return runs.agg(
        F.count_if(F.col("status") == STATUS_OK).alias("ok_runs"),
        F.count_if(F.col("status").isin(*REJECTED_STATUSES)).alias("rejected_runs"),
        F.count_if(is_scored(F.col("val_bpb"))).alias("scored_runs"),
        F.count(F.lit(1)).alias("total_runs"))


def total_training_time(runs: DataFrame) -> DataFrame:
    """A3: sum of durations with NULL as 0."""
    return runs.agg(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_training_seconds"))


def checkpoint_runs(checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """Checkpoint with the owning run's key."""
    r = runs.select(F.col("id").alias("experiment_uuid"), "experiment_id", "status", "val_bpb")
    return checkpoints.join(r, "experiment_uuid", "inner")


def parent_link(runs: DataFrame) -> DataFrame:
    """Left self-join to the parent run."""
    p = runs.select(F.col("experiment_id").alias("parent_experiment_id"),
                    F.col("val_bpb").alias("parent_val_bpb"), F.col("status").alias("parent_status"))
    out = runs.select("experiment_id", "parent_experiment_id", "val_bpb").join(p, "parent_experiment_id", "left")
    return out.withColumn("improved_on_parent",
                          F.when(is_scored(F.col("val_bpb")) & is_scored(F.col("parent_val_bpb")),
                                 F.col("val_bpb") < F.col("parent_val_bpb")))


def verify_registration(source: DataFrame, runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Compare submitted results with the registry; one row per failed rule:
    missing, val_bpb (when the source has one), git_commit (when the source's is non-empty),
    checkpoint (when the source has a path)."""
    has_ckpt = checkpoints.select("experiment_uuid").distinct().withColumn("_has_ckpt", F.lit(True))
    reg = (runs.select(F.col("id").alias("_rid"), "experiment_id", F.col("val_bpb").alias("_r_bpb"),
                       F.col("git_commit").alias("_r_commit"), F.lit(True).alias("_found"))
           .join(has_ckpt, F.col("_rid") == F.col("experiment_uuid"), "left").drop("experiment_uuid"))
    j = source.select("experiment_id", "val_bpb", "git_commit", "checkpoint_path").join(reg, "experiment_id", "left")
    found = F.col("_found").isNotNull()
    rules = F.array(
        F.when(~found, F.lit("missing")),
        F.when(found & F.col("val_bpb").isNotNull() & ~F.col("val_bpb").eqNullSafe(F.col("_r_bpb")), F.lit("val_bpb")),
        F.when(found & (F.coalesce(F.col("git_commit"), F.lit("")) != "") &
               ~F.col("git_commit").eqNullSafe(F.col("_r_commit")), F.lit("git_commit")),
        F.when(found & (F.coalesce(F.col("checkpoint_path"), F.lit("")) != "") & F.col("_has_ckpt").isNull(),
               F.lit("checkpoint")),
    )
    return (j.select("experiment_id", F.explode(rules).alias("failed_rule"))
            .where(F.col("failed_rule").isNotNull()))


def keep_discard(runs: DataFrame) -> DataFrame:
    """In time order, a scored run is kept iff its val_bpb is strictly below every earlier
    scored run (the first is the baseline and kept); unscored runs are crashes. The running
    minimum is computed in two levels (chunks of about equally many runs, then inside a chunk)."""
    from runloom.operators.ordered import prefix_agg
    d = runs.select("experiment_id", "created_at", "val_bpb").withColumn(
        "_t", cfg.epoch_micros(F.col("created_at")))
    scored = is_scored(F.col("val_bpb"))
    d = prefix_agg(d, order_col="_t", tiebreak=["experiment_id"], value=F.when(scored, F.col("val_bpb")),
                   how="min", out="best_before", inclusive=False)
    decision = (F.when(~scored, F.lit("crash"))
                .when(F.col("best_before").isNull() | (F.col("val_bpb") < F.col("best_before")), F.lit("keep"))
                .otherwise(F.lit("discard")))
    return d.select("experiment_id", "val_bpb", "best_before", decision.alias("decision"))


def cascade_delete(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame,
                   doomed: DataFrame) -> dict[str, DataFrame]:
    """Delete the runs in ``doomed`` (column ``experiment_id``): children go with them
    (CASCADE) and surviving runs pointing at a deleted parent get NULL (SET NULL)."""
    gone = doomed.select("experiment_id").distinct()
    keep_runs = runs.join(gone, "experiment_id", "left_anti")
    gone_ids = runs.join(gone, "experiment_id", "left_semi").select(F.col("id").alias("experiment_uuid"))
    keep_runs = _set_null(keep_runs, "parent_experiment_id", gone, "experiment_id")
    return {
        "runs": keep_runs,
        "metrics": metrics.join(gone_ids, "experiment_uuid", "left_anti"),
        "checkpoints": checkpoints.join(gone_ids, "experiment_uuid", "left_anti"),
    }


#: Child table, its reference, parent table and key, and what a deleted parent does to the child; parents come
#: before their children.
FOREIGN_KEYS = (
    ("experiments", "parent_experiment_id", "experiments", "experiment_id", "set null"),
    ("experiment_metrics", "experiment_uuid", "experiments", "id", "cascade"),
    ("checkpoints", "experiment_uuid", "experiments", "id", "cascade"),
    ("evaluations", "checkpoint_id", "checkpoints", "id", "cascade"),
    ("evaluations", "experiment_uuid", "experiments", "id", "set null"),
    ("inference_runs", "checkpoint_id", "checkpoints", "id", "cascade"),
)


#: Parts over which the rows without a reference are spread.
NULL_PARTS = 1024


def _by_reference(rows: DataFrame, column: str, gone: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with the distinct keys of ``gone`` (as ``_key``). Rows without a reference match nothing; a part number by
    their id, which is 0 for all others, keeps them from coming together in one task."""
    mark = gone.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    mark = mark.withColumn("_key_part", F.when(F.col("_key").isNotNull(), F.lit(0)))
    part = F.when(F.col(column).isNull(), F.pmod(F.xxhash64("id"), F.lit(NULL_PARTS)).cast("int")).otherwise(F.lit(0))
    return rows.withColumn("_part", part).join(mark, (F.col(column) == F.col("_key")) & (F.col("_part") == F.col("_key_part")), how)


def _refers(rows: DataFrame, column: str, gone: DataFrame, key: str, how: str) -> DataFrame:
    return _by_reference(rows, column, gone, key, how).select(rows.columns)


def _set_null(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    marked = _by_reference(rows, column, gone, key, "left")
    return marked.withColumn(column, F.when(F.col("_key").isNull(), F.col(column))).select(rows.columns)


def delete_propagated(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """J9 over all tables of FOREIGN_KEYS that are given: the runs in ``doomed`` (column ``experiment_id``) and, parent by
    parent, the rows that refer to a deleted one go (CASCADE); other references to deleted rows become NULL (SET NULL)."""
    gone = {"experiments": _refers(tables["experiments"], "experiment_id", doomed, "experiment_id", "left_semi")}
    kept = {"experiments": _refers(tables["experiments"], "experiment_id", doomed, "experiment_id", "left_anti")}
    for name in dict.fromkeys(child for child, *_ in FOREIGN_KEYS if child in tables):
        rules = [r for r in FOREIGN_KEYS if r[0] == name]
        cascades = [r for r in rules if r[4] == "cascade"]
        if cascades:
            lost = [_refers(tables[name], column, gone[parent], key, "left_semi") for _, column, parent, key, _ in cascades]
            gone[name] = functools.reduce(DataFrame.unionByName, lost)
            kept[name] = tables[name]
            for _, column, parent, key, _ in cascades:
                kept[name] = _refers(kept[name], column, gone[parent], key, "left_anti")
        for _, column, parent, key, rule in rules:
            if rule == "set null":
                kept[name] = _set_null(kept[name], column, gone[parent], key)
    return kept


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """J4 + V5: references of any table of FOREIGN_KEYS to rows that don't exist: (table_name, id, column_name, missing_ref)."""
    found = []
    for child, column, parent, key, _ in FOREIGN_KEYS:
        if child in tables and parent in tables:
            rows = tables[child].where(F.col(column).isNotNull()).select("id", F.col(column).alias("missing_ref"))
            known = tables[parent].select(F.col(key).alias("missing_ref"))
            found.append(rows.join(known, "missing_ref", "left_anti").select(F.lit(child).alias("table_name"), "id", F.lit(column).alias("column_name"), "missing_ref"))
    return functools.reduce(DataFrame.unionByName, found)


def key_set_diff(expected: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Names missing from ``present`` and names unexpected in it (full outer join)."""
    e = expected.select(F.col(name).alias("_e")).distinct()
    p = present.select(F.col(name).alias("_p")).distinct()
    j = e.join(p, e["_e"] == p["_p"], "full_outer")
    return (j.where(F.col("_e").isNull() | F.col("_p").isNull())
            .select(F.coalesce("_e", "_p").alias(name),
                    F.when(F.col("_p").isNull(), F.lit("missing")).otherwise(F.lit("unexpected")).alias("side")))


def lineage(runs: DataFrame) -> DataFrame:
    """Root, depth and the best val_bpb on the chain from the root to each run, by pointer doubling: every run keeps
    a stretch of its chain (nodes, best value, topmost run) and the run above it; each round joins a stretch with the
    one above, so a chain of n runs takes log2(n) rounds. Runs on a cycle have no root and no row. An unknown parent
    makes a root."""
    own = F.when(F.col("val_bpb").isNotNull() & ~F.isnan("val_bpb"), F.col("val_bpb"))
    links = runs.select("experiment_id", "parent_experiment_id", own.alias("best"))
    known = links.select(F.col("experiment_id").alias("parent_experiment_id"), F.col("experiment_id").alias("up"))
    state = links.join(known, "parent_experiment_id", "left").select(
        "experiment_id", "up", F.col("experiment_id").alias("root_id"), F.lit(1).alias("nodes"), "best").checkpoint()
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("experiment_id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"),
                             F.col("nodes").alias("nodes2"), F.col("best").alias("best2"))
        state = state.join(above, "up", "left").select(
            "experiment_id", F.col("up2").alias("up"), F.coalesce("root2", "root_id").alias("root_id"),
            (F.col("nodes") + F.coalesce("nodes2", F.lit(0))).alias("nodes"), F.least("best", "best2").alias("best")).checkpoint()
    return state.where("up is null").select("experiment_id", "root_id", (F.col("nodes") - 1).alias("depth"), F.col("best").alias("best_val_bpb"))


def compare_runs(runs: DataFrame, roles: dict[str, DataFrame], attrs: list[str]) -> DataFrame:
    """Chosen runs side by side, one row per attribute, with a difference flag. ``roles`` maps
    a role name to a frame of chosen ``experiment_id`` values (one per role)."""
    dbl = {f.name for f in runs.schema.fields if f.dataType.typeName() == "double"}

    def txt(a: str) -> Column:
        return F.when(F.col(a).isNotNull(), F.format_string("%.6f", F.col(a))) if a in dbl else F.col(a).cast("string")

    sel = None
    for role, ids in roles.items():
        part = runs.join(ids, "experiment_id", "left_semi").select(F.lit(role).alias("role"), *[txt(a).alias(a) for a in attrs])
        sel = part if sel is None else sel.unionByName(part)
    long = sel.unpivot(["role"], attrs, "attribute", "value")
    names = list(roles)
    wide = long.groupBy("attribute").pivot("role", names).agg(F.first("value"))
    out = wide.select("attribute", *[F.col(n).alias(f"{n}_value") for n in names])
    if len(names) == 2:
        a, b = (f"{n}_value" for n in names)
        out = out.withColumn("differs", ~F.col(a).eqNullSafe(F.col(b)))
    return out
