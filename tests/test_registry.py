import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shared_values import SAMPLE_RESULT
from runloom.functions import config as cfg
from runloom.operators import checks
from runloom.operators import registry as reg
from runloom.sources import results


def payload_frame(spark, docs, ts="2026-08-18 09:20:00"):
    """Write result documents as pretty JSON files (one per file) and read them back."""
    d = tempfile.mkdtemp(prefix="results-", dir="/tmp")
    for i, doc in enumerate(docs):
        with open(os.path.join(d, f"r{i:03d}.json"), "w") as f:
            body = dict(doc)
            if isinstance(body.get("configuration"), dict):
                body["configuration"] = json.dumps(body["configuration"])
            body["ingest_ts"] = ts
            json.dump(body, f, indent=2)
    return results.read_results(spark, d, multiline=True).drop("source_file")


def test_ingest_sample(spark):
    p = payload_frame(spark, [SAMPLE_RESULT])
    out = reg.ingest(p, None, ["ingest_ts"])
    runs = out["runs"].collect()
    assert len(runs) == 1
    r = runs[0]
    assert r.val_bpb == 0.8277880941165469          # exact, never a float32
    assert r.duration_seconds == 30.0               # training seconds, not total
    assert (r.completed_at - r.started_at).total_seconds() == 45.0
    assert (r.vocab_size, r.max_seq_len, r.window_pattern) == (1024, 256, "L")
    m = out["metrics"].collect()
    assert len(m) == 8 and {x.step for x in m} == {0}
    assert sum(1 for x in m if x.metric_value == 0.0) == 4  # zeros are kept
    assert {"val_bpb", "num_params"} <= {x.metric_name for x in m}
    c = out["checkpoints"].collect()
    assert len(c) == 1 and c[0].metadata.experiment_id == SAMPLE_RESULT["experiment_id"]
    assert c[0].metadata.val_bpb == SAMPLE_RESULT["val_bpb"]
    assert out["created"].collect()[0].created is True


def test_ingest_is_idempotent(spark):
    p = payload_frame(spark, [SAMPLE_RESULT])
    first = reg.ingest(p, None, ["ingest_ts"])["runs"]
    again = dict(SAMPLE_RESULT, val_bpb=0.5)
    out = reg.ingest(payload_frame(spark, [again]), first, ["ingest_ts"])
    assert out["runs"].count() == 0 and out["metrics"].count() == 0
    assert out["created"].collect()[0].created is False


def test_first_write_wins_inside_a_batch(spark):
    a = dict(SAMPLE_RESULT, val_bpb=0.9)
    b = dict(SAMPLE_RESULT, val_bpb=0.7)
    pa = payload_frame(spark, [a], ts="2026-08-18 09:00:00")
    pb = payload_frame(spark, [b], ts="2026-08-18 10:00:00")
    out = reg.ingest(pa.unionByName(pb), None, ["ingest_ts"])
    assert [r.val_bpb for r in out["runs"].collect()] == [0.9]


def test_list_filter_count_and_lookup(spark):
    runs = reg.ingest(payload_frame(spark, [SAMPLE_RESULT]), None, ["ingest_ts"])["runs"]
    assert reg.count_runs(runs).first().total == 1
    assert reg.count_runs(runs, "crash").first().total == 0
    assert reg.count_runs(runs, "").first().total == 1     # empty status = no filter
    assert reg.list_runs(runs, 50, 0).count() == 1
    assert reg.lookup(runs, "exp_missing").count() == 0     # not found
    with pytest.raises(ValueError):
        reg.list_runs(runs, 201, 0)
    with pytest.raises(ValueError):
        reg.list_runs(runs, 0, 0)
    with pytest.raises(ValueError):
        reg.list_runs(runs, 10, -1)


def test_bad_payloads_are_quarantined(spark):
    rows = [(1, json.dumps({"status": "ok"})), (2, json.dumps({"experiment_id": "x"})), (3, "not json"),
            (4, json.dumps({"experiment_id": "y", "status": "ok", "val_bpb": "n/a"})),
            (5, json.dumps({"experiment_id": "z", "status": "ok", "val_bpb": 0.9}))]
    df = spark.createDataFrame(rows, "k INT, payload STRING")
    v = {r.k: (r.reason, r.accepted) for r in checks.validate_payload_text(df, "payload").collect()}
    assert v[1][0] == "missing_experiment_id"
    assert v[2][0] == "missing_status"
    assert v[3][0] == "not_json"
    assert v[4][0] == "bad_val_bpb"
    assert v[5] == (None, True)


def test_every_payload_field_has_its_type(spark):
    ok = {"experiment_id": "e", "status": "ok", "val_bpb": 0.9}
    wrong = {"experiment_id": 5, "git_commit": 1, "git_dirty": "maybe", "status": 7, "crash_message": ["x"], "val_bpb": {}, "training_seconds": "long",
             "total_seconds": [], "peak_vram_mb": "?", "mfu_percent": {}, "total_tokens": 1.5, "num_steps": "2.5", "num_params": "many", "depth": "four",
             "checkpoint_path": False, "configuration": 3, "parent_experiment_id": 9}
    fine = [{"depth": "4"}, {"num_steps": 12.0}, {"git_dirty": True}, {"configuration": {"n": [1]}}, {"configuration": '{"n": 1}'}, {"git_commit": None},
            {"val_bpb": "0.9"}, {"unknown": 1}]
    texts = [json.dumps(ok | {k: v}) for k, v in wrong.items()] + [json.dumps(ok | f) for f in fine] + ["[1]", "null", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, payload STRING")
    got = {r.k: (r.reason, r.accepted) for r in checks.validate_payload_text(df, "payload").collect()}
    assert [got[i] for i in range(len(wrong))] == [(f"bad_{k}", False) for k in wrong]
    assert [got[len(wrong) + i] for i in range(len(fine))] == [(None, True)] * len(fine)
    assert [got[len(texts) - 3 + i][0] for i in range(3)] == ["missing_experiment_id", "missing_experiment_id", "not_json"]
    good = {r.k: r for r in checks.split_valid(df, "payload")[0].collect()}
    assert good[len(wrong)].depth == 4 and good[len(wrong) + 1].num_steps == 12 and json.loads(good[len(wrong) + 3].configuration) == {"n": [1]}


def test_verify_registration_passes_for_the_sample(spark):
    p = payload_frame(spark, [SAMPLE_RESULT])
    out = reg.ingest(p, None, ["ingest_ts"])
    assert reg.verify_registration(p, out["runs"], out["checkpoints"]).count() == 0
    missing = reg.verify_registration(p, out["runs"].limit(0), out["checkpoints"]).collect()
    assert [r.failed_rule for r in missing] == ["missing"]


def test_latest_result_by_file_name(spark):
    d = tempfile.mkdtemp(prefix="latest-", dir="/tmp")
    for name in ("exp_b.json", "exp_a.json"):
        with open(os.path.join(d, name), "w") as f:
            json.dump({"experiment_id": name[:-5], "status": "ok"}, f)
    r = results.read_results(spark, d, multiline=True)
    latest = r.agg(F.max_by("experiment_id", F.col("source_file")).alias("x")).first().x
    assert latest == "exp_b"


def test_model_arithmetic_of_the_sample(spark):
    df = spark.createDataFrame([(4, 1024, 256, "L")], "depth INT, vocab INT, seq INT, pattern STRING")
    pc = cfg.param_counts(F.col("depth"), F.col("vocab"))
    r = df.select(pc["total"].alias("n"), cfg.flops_per_token(F.col("depth"), F.col("vocab"), F.col("seq"),
                                                             F.col("pattern")).alias("f"),
                  cfg.model_dim(F.col("depth")).alias("d"), cfg.n_heads(F.col("depth")).alias("h")).first()
    assert (r.n, r.f, r.d, r.h) == (4_194_440, 23_593_728, 256, 2)


def test_batch_arithmetic(spark):
    df = spark.createDataFrame([(32, 256)], "b INT, t INT")
    m = cfg.batch_math(F.col("b"), F.col("t"))
    r = df.select(*[v.alias(k) for k, v in m.items()]).first()
    assert r.batch_divisible and r.grad_accum_steps == 2 and r.eval_steps == 8 and r.eval_ok


def test_schedules(spark):
    df = spark.createDataFrame([(0.0, 0), (0.75, 150), (1.0, 600)], "p DOUBLE, s INT")
    r = df.select(cfg.lr_multiplier(F.col("p")).alias("l"), cfg.muon_momentum(F.col("s")).alias("m"),
                  cfg.weight_decay(F.col("p")).alias("w")).collect()
    assert [x.l for x in r] == [1.0, 0.5, 0.0]
    assert [round(x.m, 6) for x in r] == [0.85, 0.9, 0.95]
    assert [round(x.w, 6) for x in r] == [0.2, 0.05, 0.0]


def test_order_and_tie_rules(spark):
    from datetime import datetime
    rows = [("exp_b", datetime(2026, 1, 2), 0.5, "ok"), ("exp_a", datetime(2026, 1, 2), 0.5, "ok"),
            ("exp_c", datetime(2026, 1, 1), 0.5, "ok"), ("exp_d", datetime(2026, 1, 3), None, "crash")]
    runs = spark.createDataFrame(rows, "experiment_id STRING, created_at TIMESTAMP, val_bpb DOUBLE, status STRING") \
        .withColumn("duration_seconds", F.lit(10.0)).withColumn("num_params", F.lit(1).cast("long")) \
        .withColumn("depth", F.lit(4))
    # newest first, ties by id
    assert [r.experiment_id for r in runs.orderBy(*reg.newest_first()).collect()] == ["exp_d", "exp_a", "exp_b", "exp_c"]
    # best: lowest val_bpb, ties go to the newest run (first in the list), then the smaller id
    assert reg.best_run(runs).first().experiment_id == "exp_a"
    o = reg.overview(runs).first()
    assert (o.total_runs, o.ok_runs, o.rejected_runs, o.total_training_seconds) == (4, 3, 1, 40.0)
    assert o.latest_experiment_id == "exp_d" and o.best_experiment_id == "exp_a"
    kd = {r.experiment_id: r.decision for r in reg.keep_discard(runs).collect()}
    assert kd == {"exp_c": "keep", "exp_a": "discard", "exp_b": "discard", "exp_d": "crash"}


def test_split_valid_parses_good_rows_and_quarantines_the_rest(spark):
    rows = [(1, json.dumps({"experiment_id": "exp_1", "status": "ok", "val_bpb": 0.81, "num_params": 7})),
            (2, "{broken"), (3, json.dumps({"experiment_id": "exp_3"}))]
    df = spark.createDataFrame(rows, "k INT, payload STRING")
    good, bad = checks.split_valid(df, "payload")
    g = good.collect()
    assert [(r.k, r.experiment_id, r.val_bpb, r.num_params) for r in g] == [(1, "exp_1", 0.81, 7)]
    assert {r.k: r.reason for r in bad.collect()} == {2: "not_json", 3: "missing_status"}


def test_lineage_of_a_long_chain_and_a_cycle(spark):
    from runloom.operators import registry as reg
    n = 3000
    rows = [(f"r{i}", f"r{i - 1}" if i else None, 1.0 + i) for i in range(n)] + [("a", "b", 0.5), ("b", "a", 0.5), ("x", "gone", None)]
    out = {r.experiment_id: r for r in reg.lineage(spark.createDataFrame(rows, "experiment_id string, parent_experiment_id string, val_bpb double")).collect()}
    assert len(out) == n + 1 and out[f"r{n - 1}"].depth == n - 1 and out[f"r{n - 1}"].root_id == "r0" and out[f"r{n - 1}"].best_val_bpb == 1.0
    assert out["x"].depth == 0 and out["x"].root_id == "x" and out["x"].best_val_bpb is None


def test_latest_result_goes_by_file_name(spark, tmp_path):
    import json

    import pytest
    from runloom.sources import results
    for name, run in (("exp_a.json", "zzz"), ("exp_b.json", "aaa")):
        (tmp_path / name).write_text(json.dumps({"experiment_id": run, "status": "ok"}, indent=2))
    assert results.latest_result(results.read_results(spark, str(tmp_path), multiline=True), one_per_file=True).first().experiment_id == "aaa"
    none = results.read_results(spark, str(tmp_path), multiline=True).where("false")
    with pytest.raises(Exception, match="no result files"):
        results.latest_result(none, one_per_file=True).collect()


def test_deletes_reach_grandchildren(spark):
    frame = spark.createDataFrame
    tables = {"experiments": frame([("u1", "a", None), ("u2", "b", "a"), ("u3", "c", "b")], "id string, experiment_id string, parent_experiment_id string"),
              "checkpoints": frame([("c1", "u1"), ("c2", "u2")], "id string, experiment_uuid string"),
              "evaluations": frame([("e1", "c1", "u2"), ("e2", "c2", "u1"), ("e3", "c2", "u3"), ("e4", "c2", None)], "id string, checkpoint_id string, experiment_uuid string"),
              "inference_runs": frame([("i1", "c1"), ("i2", "c2"), ("i3", "c9")], "id string, checkpoint_id string")}
    kept = {k: sorted(map(tuple, v.collect()), key=str) for k, v in reg.delete_propagated(tables, frame([("a",), ("zz",)], "experiment_id string")).items()}
    assert kept == {"experiments": [("u2", "b", None), ("u3", "c", "b")], "checkpoints": [("c2", "u2")],
                    "evaluations": [("e2", "c2", None), ("e3", "c2", "u3"), ("e4", "c2", None)], "inference_runs": [("i2", "c2"), ("i3", "c9")]}
    assert [tuple(r) for r in reg.reference_violations(tables).collect()] == [("inference_runs", "i3", "checkpoint_id", "c9")]
