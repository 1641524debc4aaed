from pyspark.sql import functions as F

from shared_values import SF_SMALL
from runloom.operators import telemetry as tel
from runloom.plans import q_streams
from runloom.plans import standins as st
from runloom.plans.q_streams import _deliver_payloads, _deliver_steps
from runloom.session import work_dir
from runloom.sources import registry_io
from runloom.streaming import ingest as sing
from runloom.streaming import telemetry_state as sts


def test_stream_ingest_equals_batch_and_survives_restart(spark):
    src, base, cp = work_dir(spark, "t-src"), work_dir(spark, "t-reg"), work_dir(spark, "t-cp")
    p = _deliver_payloads(spark, SF_SMALL, src)
    sing.start_ingest(spark, src, base, cp)
    runs = registry_io.read_table(spark, base, "experiments")
    batch = st.runs(spark, SF_SMALL)
    assert runs.count() == batch.count()
    cols = ["experiment_id", "status", "val_bpb", "duration_seconds", "created_at"]
    assert runs.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    n_metrics = registry_io.read_table(spark, base, "experiment_metrics").count()
    # restart with nothing new, then a duplicate delivery with other values: nothing changes
    sing.start_ingest(spark, src, base, cp)
    p.withColumn("status", F.lit("crash")).write.mode("append").option("ignoreNullFields", False).json(src)
    sing.start_ingest(spark, src, base, cp)
    after = registry_io.read_table(spark, base, "experiments")
    assert after.count() == batch.count()
    assert after.where(F.col("status") == "crash").count() == batch.where(F.col("status") == "crash").count()
    assert registry_io.read_table(spark, base, "experiment_metrics").count() == n_metrics


def test_micro_batches_do_not_grow_with_the_files(spark, monkeypatch):
    """40 files of deliveries are taken in about as many micro-batches as 4 are."""
    took = []

    def deliver(spark, d, src):
        p = spark.createDataFrame([(f"exp_{i}", "ok", 1.0) for i in range(80)], "experiment_id string, status string, val_bpb double")
        p.repartition(40).write.mode("append").json(src)
        return p
    monkeypatch.setattr(q_streams, "_deliver_payloads", deliver)
    monkeypatch.setattr(sing, "start_ingest", lambda spark, src, base, cp, max_files=2: took.append((len(spark.read.text(src).inputFiles()), max_files)))
    q_streams._ingested(spark, SF_SMALL)
    assert took[0][0] >= 30 and all(4 * n >= 30 for _, n in took)


def test_replayed_batch_is_idempotent(spark):
    base = work_dir(spark, "t-replay")
    runs, m, c = st.runs(spark, SF_SMALL), st.metrics(spark, SF_SMALL), st.checkpoints(spark, SF_SMALL)
    registry_io.append_tables(runs, m, c, base, 3)
    registry_io.append_tables(runs, m, c, base, 3)
    assert registry_io.read_table(spark, base, "experiments").count() == runs.count()
    assert registry_io.read_table(spark, base, "experiment_metrics").count() == m.count()


def test_stream_state_equals_batch(spark):
    src = _deliver_steps(spark, SF_SMALL)
    sink, cp = work_dir(spark, "t-ema"), work_dir(spark, "t-ema-cp")
    sts.start_loss_ema(spark, src, sink, cp)
    s = spark.read.parquet(sink).select("experiment_id", "step", F.col("ema_loss").alias("s"),
                                        F.col("training_time").alias("st"))
    b = tel.loss_ema(st.training_steps(spark, SF_SMALL)).select("experiment_id", "step", F.col("ema_loss").alias("b"))
    t = tel.training_progress(st.training_steps(spark, SF_SMALL)).select("experiment_id", "step", "training_time")
    j = s.join(b, ["experiment_id", "step"]).join(t, ["experiment_id", "step"])
    assert j.count() == b.count()
    assert j.where((F.abs(F.col("s") - F.col("b")) > 1e-9) | (F.abs(F.col("st") - F.col("training_time")) > 1e-9)).count() == 0


def test_stream_quarantines_bad_payloads(spark):
    import os
    src, base, cp = work_dir(spark, "t-bad-src"), work_dir(spark, "t-bad-reg"), work_dir(spark, "t-bad-cp")
    local = src.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "batch1.json"), "w") as f:
        f.write('{"experiment_id": "exp_1", "status": "ok", "val_bpb": 0.9, "ingest_ts": "2026-01-01T00:00:00"}\n')
        f.write('{"status": "ok"}\n')
        f.write('this is not json\n')
        f.write('{"experiment_id": "exp_2", "status": "fail"}\n')
    sing.start_ingest(spark, src, base, cp)
    runs = {r.experiment_id: r for r in registry_io.read_table(spark, base, "experiments").collect()}
    assert set(runs) == {"exp_1", "exp_2"}
    assert runs["exp_2"].completed_at is not None          # no arrival time: the batch's processing time
    q = {r.reason for r in registry_io.read_table(spark, base, "quarantine").collect()}
    assert q == {"missing_experiment_id", "not_json"}


def test_shuffled_and_repeated_deliveries_equal_batch(spark):
    import math
    import random
    rng = random.Random(6)
    steps = []
    for run, n in (("a", 60), ("b", 25), ("c", 1)):
        steps += [(run, i, rng.random() * 3 if (run, i) not in (("a", 40), ("b", 7)) else (math.nan if run == "a" else 200.0), 20.0 + i, i) for i in range(n)]
    frame = spark.createDataFrame(steps, "experiment_id string, step int, loss double, dt double, vram_bytes long")
    src, sink, cp = work_dir(spark, "t-late"), work_dir(spark, "t-late-sink"), work_dir(spark, "t-late-cp")
    shuffled = steps[:]
    rng.shuffle(shuffled)
    for i in range(5):
        part = shuffled[i::5] + rng.sample(steps, 10)  # delivered again
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(src)
    sts.start_loss_ema(spark, src, sink, cp)
    got = {(r.experiment_id, r.step): r for r in spark.read.parquet(sink).collect()}
    assert len(got) == spark.read.parquet(sink).count() == len(steps) and not any(r.late for r in got.values())
    for r in tel.loss_ema(frame).collect():
        g = got[r.experiment_id, r.step]
        assert (math.isnan(g.ema_loss) and math.isnan(r.ema_loss)) or abs(g.ema_loss - r.ema_loss) < 1e-9
    for r in tel.training_progress(frame).collect():
        assert abs(got[r.experiment_id, r.step].training_time - r.training_time if r.training_time is not None else got[r.experiment_id, r.step].training_time) < 1e-9
    for r in tel.stop_steps(frame).collect():
        stops = {k[1]: g.stop_reason for k, g in got.items() if k[0] == r.experiment_id and g.stop_reason}
        assert stops == ({} if r.stop_reason == "end" else {r.fail_step if r.stop_reason == "fail" else r.time_step: r.stop_reason})
        at = min(stops, default=10**9)
        assert all(g.after_stop == (k[1] > at) for k, g in got.items() if k[0] == r.experiment_id)


def test_a_gap_given_up_loses_no_step():
    state = sts.RunState()
    assert [r[0] for r in state.take(0, 1.0, 1.0)] == [0] and state.take(2, 1.0, 1.0) == [] and state.take(3, 2.0, 1.0) == []
    state = sts.RunState(state.held())
    assert [r[0] for r in state.give_up()] == [2, 3] and state.give_up() == []
    assert state.take(1, 9.0, 1.0) == [(1, None, None, None, None, None, None, True)] and state.take(1, 9.0, 1.0) == []
    assert [r[0] for r in state.take(4, 1.0, 1.0)] == [4] and state.take(4, 1.0, 1.0) == []


def test_stream_has_the_rules_of_the_batch(spark):
    import os
    from runloom.operators import checks
    src, base, cp = work_dir(spark, "t-rules-src"), work_dir(spark, "t-rules-reg"), work_dir(spark, "t-rules-cp")
    os.makedirs(src.replace("file:", ""))
    texts = ['{"experiment_id": "a", "status": "ok", "val_bpb": "0.8"}', '{"experiment_id": 5, "status": "ok"}', '{"experiment_id": "b"}', "[1]", "{",
             '{"experiment_id": "c", "status": "ok", "configuration": {"vocab_size": 7}, "depth": 4.0, "ingest_ts": "2026-01-01T00:00:00"}', '{"experiment_id": "d", "status": "ok", "depth": 4.5}']
    with open(os.path.join(src.replace("file:", ""), "lines.json"), "w") as f:
        f.write("\n\n".join(texts))
    sing.start_ingest(spark, src, base, cp)
    batch = {r.value: (r.experiment_id, r.reason) for r in checks.validate_payload_text(spark.createDataFrame([(t,) for t in texts], "value string"), "value").collect()}
    bad = {r.value: (r.experiment_id, r.reason) for r in registry_io.read_table(spark, base, "quarantine").collect()}
    assert bad == {k: v for k, v in batch.items() if v[1] is not None} and len(bad) == 5
    runs = {r.experiment_id: r for r in registry_io.read_table(spark, base, "experiments").collect()}
    assert set(runs) == {"a", "c"} and runs["a"].val_bpb == 0.8 and (runs["c"].vocab_size, runs["c"].depth, str(runs["c"].completed_at)) == (7, 4, "2026-01-01 00:00:00")


def test_pretty_printed_files_in_the_stream(spark):
    import json
    import os
    from shared_values import SAMPLE_RESULT
    src, base, cp = work_dir(spark, "t-pretty-src"), work_dir(spark, "t-pretty-reg"), work_dir(spark, "t-pretty-cp")
    os.makedirs(src.replace("file:", ""))
    with open(os.path.join(src.replace("file:", ""), SAMPLE_RESULT["experiment_id"] + ".json"), "w") as f:
        json.dump(SAMPLE_RESULT, f, indent=2)
    sing.start_ingest(spark, src, base, cp, multiline=True)
    run = registry_io.read_table(spark, base, "experiments").first()
    assert (run.experiment_id, run.val_bpb, run.vocab_size) == (SAMPLE_RESULT["experiment_id"], SAMPLE_RESULT["val_bpb"], 1024)


def test_a_half_written_batch_shows_nowhere(spark):
    base = work_dir(spark, "t-half")
    runs, m, c = st.runs(spark, SF_SMALL), st.metrics(spark, SF_SMALL), st.checkpoints(spark, SF_SMALL)
    registry_io.append_part(m, base, "experiment_metrics", 1)
    registry_io.append_part(runs, base, "experiments", 1)
    assert registry_io.read_table(spark, base, "experiment_metrics").count() == registry_io.read_table(spark, base, "experiments").count() == 0
    registry_io.append_tables(runs.limit(3), m.limit(3), c.limit(3), base, 2)
    assert registry_io.read_table(spark, base, "experiment_metrics").count() == registry_io.read_table(spark, base, "experiments").count() == 3
    registry_io.append_tables(runs, m, c, base, 1)  # the batch again, whole
    assert registry_io.read_table(spark, base, "experiment_metrics").count() == m.count() + 3


def test_known_runs_read_the_batch_buckets_only(spark):
    base = work_dir(spark, "t-buckets")
    runs = st.runs(spark, SF_SMALL)
    registry_io.append_tables(runs, st.metrics(spark, SF_SMALL), st.checkpoints(spark, SF_SMALL), base, 0)
    ids = runs.orderBy("experiment_id").limit(2).select("experiment_id")
    known = registry_io.known_runs(spark, base, ids, 1)
    plan = spark._jvm.PythonSQLUtils.explainString(known._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters", 1)[1].split("\n")[0]
    assert 2 <= known.count() < runs.count() / 4
    assert known.join(ids, "experiment_id", "left_semi").count() == 2
    assert registry_io.known_runs(spark, base, ids, 0).count() == 0
