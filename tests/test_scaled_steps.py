"""Steps that were changed to scale give the same rows: references that are null, few runs, small splits."""

import os

import pytest
from pyspark.sql import functions as F

from runloom.operators import bpe, checks
from runloom.operators import registry as reg
from runloom.plans import q_streams
from runloom.session import discard, work_dir
from runloom.sources import registry_io


def test_rows_without_a_reference_are_spread_and_stay(spark):
    runs = spark.createDataFrame([(f"r{i}", f"e{i}", None if i % 2 else f"e{i - 1}") for i in range(1, 9)] + [("r1", "e1", None)], "id string, experiment_id string, parent_experiment_id string")
    evals = spark.createDataFrame([(f"v{i}", None if i % 3 else f"c{i % 4}", None if i % 2 else f"r{i % 9}") for i in range(200)], "id string, checkpoint_id string, experiment_uuid string")
    points = spark.createDataFrame([("c1", "r1"), ("c2", "r2"), ("c9", None)], "id string, experiment_uuid string")
    kept = reg.delete_propagated({"experiments": runs, "checkpoints": points, "evaluations": evals}, runs.where("experiment_id = 'e1'"))
    want = sorted((r.id, r.checkpoint_id or "", "" if r.experiment_uuid in (None, "r1") else r.experiment_uuid) for r in evals.collect() if r.checkpoint_id != "c1")
    assert sorted((r.id, r.checkpoint_id or "", r.experiment_uuid or "") for r in kept["evaluations"].collect()) == want
    assert sorted(r.id for r in kept["checkpoints"].collect()) == ["c2", "c9"]
    assert {r.experiment_id: r.parent_experiment_id for r in kept["experiments"].collect()} == {f"e{i}": None if i % 2 or i == 2 else f"e{i - 1}" for i in range(2, 9)}
    nulls = spark.range(4000).select(F.col("id").cast("string"), F.lit(None).cast("string").alias("ref"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = reg._by_reference(nulls, "ref", runs, "id", "left").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 4000 and len(sizes) > 1 and max(r["count"] for r in sizes) < 4000


def test_details_of_few_runs_broadcast_no_child_table(spark):
    runs = spark.createDataFrame([("r1", "e1"), ("r2", "e2"), ("r2", "e2")], "id string, experiment_id string")
    metrics = spark.createDataFrame([("m1", "r1", "a", 1.0, 1, None), ("m2", "r2", "b", 2.0, 1, None), ("m3", "r3", "c", 3.0, 1, None)],
                                    "id string, experiment_uuid string, metric_name string, metric_value double, step int, recorded_at timestamp")
    points = spark.createDataFrame([("c1", "r2", "p", None, None)], "id string, experiment_uuid string, checkpoint_path string, created_at timestamp, metadata string")
    one, two = (sorted((r.experiment_id, len(r.metrics), len(r.checkpoints)) for r in reg.detail_nested(runs, metrics, points, few).collect()) for few in (False, True))
    assert one == two == [("e1", 1, 0), ("e2", 1, 1), ("e2", 1, 1)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reg.detail_nested(runs, metrics, points, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_splits_of_bucketed_writes(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with registry_io.small_splits(spark):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(registry_io.SORTED_SPLIT)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_roundtrip_of_odd_texts(spark):
    texts = [(1, "añ 漢字 x"), (2, ""), (3, None), (4, "\U0001f600\n\t "), (5, "a" * 2_000_000)]
    got = {r.doc_id: r.roundtrip_ok for r in bpe.roundtrip(spark.createDataFrame(texts, "doc_id long, text string"), bpe.vocab_rows([(256, 97, 97, 1)])).collect()}
    assert got == {1: True, 2: True, 3: None, 4: True, 5: True}


def test_shuffled_deliveries_are_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(q_streams, "DELIVERY_ROWS", 300)
    src, files = q_streams._deliver_shuffled(spark, "/root/testdata/sf0.01")
    steps = q_streams.st.training_steps(spark, "/root/testdata/sf0.01")
    written = spark.read.parquet(src)
    assert files > 1 and 4 <= written.select(F.input_file_name()).distinct().count() <= 4 * files
    assert written.count() == steps.count() and written.exceptAll(steps).isEmpty()


def test_a_replay_holds_no_part_twice_and_shows_nothing_until_it_is_whole(spark, monkeypatch):
    base = work_dir(spark, "t-twice")
    tables = [spark.createDataFrame([(f"r{i}", f"e{i}")], "id string, experiment_id string") for i in range(3)]
    registry_io.append_tables(*tables, base, 5)
    registry_io.append_tables(*tables, base, 6)
    append, there = registry_io.append_part, []

    def watched(df, base, name, batch_id, *by):
        there.append((name, registry_io.table_exists(spark, base, f"{name}/batch_id={batch_id}"), registry_io.table_exists(spark, base, "commits/batch_id=6")))
        if name == "experiments" and len(there) < 4:
            raise RuntimeError("lost")
        append(df, base, name, batch_id, *by)
    monkeypatch.setattr(registry_io, "append_part", watched)
    with pytest.raises(RuntimeError):
        registry_io.append_tables(*tables, base, 6)
    assert there == [("experiment_metrics", False, False), ("checkpoints", False, False), ("experiments", False, False)]
    assert [registry_io.read_table(spark, base, name).count() for name in registry_io.TABLES] == [1, 1, 1]
    registry_io.append_tables(*tables, base, 6)
    assert [registry_io.read_table(spark, base, name).count() for name in registry_io.TABLES] == [2, 2, 2]
    assert all(".zstd." in f for name in registry_io.TABLES for f in spark.read.parquet(f"{base}/{name}").inputFiles())
    discard(spark, base)
    assert not registry_io.table_exists(spark, base, "experiments")


def test_deliveries_are_packed_files_and_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(q_streams, "FILE_ROWS", 7)
    src = work_dir(spark, "t-packed")
    q_streams._write_payloads(spark.range(100).coalesce(1), src)
    files = spark.read.text(src).withColumn("file", F.input_file_name()).groupBy("file").count().collect()
    assert all(r.file.endswith(".json.gz") and r["count"] <= 7 for r in files) and sum(r["count"] for r in files) == 100
    monkeypatch.setattr(q_streams, "BATCH_FILES", 3)
    assert len(files) == 15 and q_streams._files_of_a_batch(spark, src) == 3


def test_fields_and_checks_of_a_payload_are_read_once(spark):
    texts = [('{"experiment_id": "a", "status": "ok", "val_bpb": "0.5", "ingest_ts": "2026-01-01T00:00:00"}',), ('{"experiment_id": 1, "status": "ok"}',), ("[]",), ("{",), (None,)]
    d = checks.checked(spark.createDataFrame(texts, "value string"), "value", {"ingest_ts": "timestamp_ntz"})
    assert d.columns == ["value", "ingest_ts", "_p"]
    assert [r.reason for r in d.select("_p.reason").collect()] == [None, "bad_experiment_id", "missing_experiment_id", "not_json", "not_json"]
    assert [r.n for r in d.select(F.col("ingest_ts").cast("string").alias("n")).collect()] == ["2026-01-01 00:00:00", None, None, None, None]
    plan = checks.split_checked(d, "value")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    generate = next(x for x in plan.split("\n") if "Generate" in x)
    assert "variant_get" not in generate
