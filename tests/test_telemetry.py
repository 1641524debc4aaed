from pyspark.sql import functions as F

from runloom.operators import telemetry as tel
from runloom.operators.ordered import prefix_agg, with_position


def steps_df(spark, rows):
    return spark.createDataFrame(rows, "experiment_id STRING, step INT, loss DOUBLE, dt DOUBLE, vram_bytes LONG")


def test_ema_hand_case(spark):
    s = steps_df(spark, [("r", 0, 10.0, 1.0, 1), ("r", 1, 20.0, 1.0, 1)])
    e = {r.step: r for r in tel.loss_ema(s).collect()}
    assert round(e[0].smooth_loss, 6) == 1.0 and round(e[1].smooth_loss, 6) == 2.9
    assert round(e[0].ema_loss, 6) == 10.0 and round(e[1].ema_loss, 6) == 15.263158


def test_ema_chunks_equal_plain_recursion(spark):
    rows = [("r", i, float((i * 37) % 11), 0.1, 1) for i in range(700)]
    e = {r.step: r.ema_loss for r in tel.loss_ema(steps_df(spark, rows), width=512).collect()}
    s = 0.0
    for i, (_, _, x, _, _) in enumerate(rows):
        s = 0.9 * s + (1 - 0.9) * x
        assert abs(e[i] - s / (1 - 0.9 ** (i + 1))) < 1e-9


def test_stop_rules(spark):
    # 20 steps of 1 s; budget 5 s counts steps after 10: the run stops after step 15 (11..15 = 5 s)
    rows = [("time", i, 1.0, 1.0, i) for i in range(20)]
    rows += [("fail", i, 200.0 if i == 3 else 1.0, 1.0, i) for i in range(20)]
    rows += [("nan", i, float("nan") if i == 12 else 1.0, 1.0, i) for i in range(13)]
    st = {r.experiment_id: r for r in tel.stop_steps(steps_df(spark, rows), budget=5).collect()}
    assert (st["time"].stop_reason, st["time"].num_steps) == ("time", 16)
    assert (st["fail"].stop_reason, st["fail"].num_steps) == ("fail", 3)
    assert (st["nan"].stop_reason, st["nan"].num_steps) == ("fail", 12)
    summ = {r.experiment_id: r for r in tel.run_summary(steps_df(spark, rows), 1000, budget=5).collect()}
    assert summ["time"].training_seconds == 5.0 and summ["time"].total_tokens == 16 * 16384
    assert summ["fail"].status == "fail" and summ["fail"].mfu_percent == 0.0


def test_progress_uses_time_before_the_step(spark):
    rows = [("r", i, 1.0, 2.0, 0) for i in range(14)]
    p = {r.step: r for r in tel.training_progress(steps_df(spark, rows), budget=4).collect()}
    assert p[11].progress == 0.0 and p[11].training_time == 2.0 and p[11].remaining == 2.0
    assert p[12].progress == 0.5 and p[13].progress == 1.0 and p[13].remaining == 0.0


def test_two_level_scans_match_a_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), (F.col("id") % 3).alias("g"),
                                     ((F.col("id") * 13) % 101).cast("double").alias("v"))
    ours = prefix_agg(df, order_col="k", partition_cols=["g"], value="v", how="sum", out="s", width=64)
    ours = with_position(ours, order_col="k", out="pos", width=100)
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("s2", F.sum("v").over(w)).withColumn("pos2", F.row_number().over(Window.orderBy("k")) - 1)
    j = ours.join(ref, ["k", "g", "v"])
    assert j.where((F.col("s") != F.col("s2")) | (F.col("pos") != F.col("pos2"))).count() == 0
    assert j.count() == 5000


def test_ema_is_the_recursion_for_any_beta_and_after_nan(spark):
    losses = [1.0] * 6000
    losses[5000] = float("nan")
    frame = spark.createDataFrame([("a", i, x) for i, x in enumerate(losses)], "experiment_id string, step int, loss double")
    for beta in (0.9, 0.999, 0.5):
        got = {r.step: r.ema_loss for r in tel.loss_ema(frame, beta=beta).collect()}
        assert all(abs(got[i] - 1.0) < 1e-9 for i in (0, 1, 900, 2185, 4999))
        assert all(got[i] != got[i] for i in (5000, 5001, 5999))


def test_ema_tree_of_several_levels(spark):
    rows = [(r, i, float((i * 37) % 11), 0.1, 1) for r, n in (("long", 3_000), ("short", 5)) for i in range(n)]
    frame = steps_df(spark, rows)
    deep = {(r.experiment_id, r.step): r.ema_loss for r in tel.loss_ema(frame, width=8, fan=3).collect()}
    s = 0.0
    for r, i, x, _, _ in rows:
        s = 0.9 * (s if i else 0.0) + (1 - 0.9) * x
        assert abs(deep[r, i] - s / (1 - 0.9 ** (i + 1))) < 1e-9


def test_chunks_of_sparse_ids_and_a_busy_day_are_even(spark):
    from runloom.operators import ordered
    busy = [i * 10**9 for i in range(500)] + [77 * 10**9 + i for i in range(1, 9_500)]
    df = spark.createDataFrame([(v,) for v in busy], "k long")
    bounds = ordered.split_bounds(df, "k", 100)
    chunks = [r["count"] for r in df.groupBy(ordered.split_of(F.col("k"), bounds).alias("c")).count().collect()]
    assert len(chunks) > 90 and max(chunks) < 300
    got = {r.k: (r.pos, r.low) for r in prefix_agg(with_position(df, order_col="k", width=100), order_col="k", value=-F.col("k"), how="min", out="low", width=64, inclusive=False).collect()}
    assert got == {k: (i, -sorted(busy)[i - 1] if i else None) for i, k in enumerate(sorted(busy))}
    assert with_position(df.where("false"), order_col="k").count() == 0
