from pyspark.sql import functions as F

from runloom.functions import fmt


def test_display_formats(spark):
    df = spark.createDataFrame([(0.8277880941165469, 30.0, 4194440, "5cbf07514cc", True),
                                (None, 119.6, 1500, "", None), (float("nan"), 65.0, 999, None, False)],
                               "v DOUBLE, d DOUBLE, n LONG, c STRING, dirty BOOLEAN")
    r = df.select(fmt.val_bpb_text(F.col("v")).alias("v"), fmt.duration_text(F.col("d")).alias("d"),
                  fmt.params_text(F.col("n")).alias("n"), fmt.commit_with_dirty(F.col("c"), F.col("dirty")).alias("c")
                  ).collect()
    assert [x.v for x in r] == ["0.827788", "—", "—"]
    assert [x.d for x in r] == ["30.0s", "1m 60s", "1m 5s"]      # 119.6 -> '1m 60s' is kept on purpose
    assert [x.n for x in r] == ["4.19M", "1.5K", "999"]
    assert [x.c for x in r] == ["5cbf075*", "—", "—"]


def test_labels_and_ids(spark):
    df = spark.createDataFrame([("2026-08-18 09:18:52", 4, 256, None, 46080.0)], "t STRING, d INT, s INT, v INT, m DOUBLE")
    r = df.select(fmt.timestamp_text(F.col("t")).alias("t"), fmt.timestamp_text(F.lit("later")).alias("u"),
                  fmt.config_label(F.col("d"), F.col("s"), F.col("v")).alias("l"),
                  fmt.run_id_from_time(F.to_timestamp("t")).alias("id"), fmt.memory_gb(F.col("m")).alias("gb"),
                  fmt.status_class(F.lit("crash")).alias("k")).first()
    assert r.t == "Aug 18 2026 09:18" and r.u == "later"
    assert r.l == "d4 / L256 / v—" and r.id == "exp_20260818_091852" and r.gb == 45.0 and r.k == "bad"
    back = df.select(fmt.time_from_run_id(F.lit("exp_20260818_091852")).alias("x"),
                     fmt.time_from_run_id(F.lit("exp_7")).alias("y")).first()
    assert str(back.x) == "2026-08-18 09:18:52" and back.y is None


def test_pretty_json(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":"x"}}',)], "j STRING")
    assert df.select(fmt.pretty_json(F.col("j")).alias("p")).first().p == '{\n  "a": 1,\n  "b": {\n    "c": "x"\n  }\n}'


def test_parameter_counts_round_as_the_binary_quotient(spark):
    from pyspark.sql import functions as F
    from runloom.functions import fmt
    want = {1_005_000: "1.00M", 1_125_000: "1.13M", 1_015_000: "1.01M", 50_300_000: "50.30M", 1_250: "1.3K", 1_350: "1.4K", 1_050: "1.1K", 999: "999"}
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in want], "n long").select("n", fmt.params_text(F.col("n")).alias("t")).collect()}
    assert got == want
