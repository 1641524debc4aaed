import os

from runloom.session import work_dir
from runloom.sources import logs

STEP = "step {:05d} ({:.1f}%) | loss: 1.500000 | lrm: 1.00 | dt: 250ms | tok/sec: 65,536 | mfu: 1.0% | epoch: 1 | remaining: 299s    "
SUMMARY = "---\nval_bpb:          {}\ntraining_seconds: 300.1\ntotal_seconds:    325.9\npeak_vram_mb:     45060.2\nmfu_percent:      39.80\ntotal_tokens_M:   499.6\nnum_steps:        2\nnum_params_M:     50.3\ndepth:            4\n"


def test_logs_as_the_job_prints_them(spark):
    path = work_dir(spark, "t-logs").replace("file:", "")
    os.makedirs(path)
    steps = "".join("\r" + STEP.format(i, i) for i in range(2))
    files = {
        "ok.log": "Vocab size: 1,024\nExperiment: a\nParameter counts:\n  depth: 9\n" + steps + "\n" + SUMMARY.format("0.997900") + "Checkpoint saved: x\n",
        "crash.log": "Experiment: b\r\n" + steps + "\nTraining crashed: no: memory\n\n" + SUMMARY.format("n/a"),
        "fail.log": "Experiment: c\n" + steps + "FAIL\n\n" + SUMMARY.format("n/a"),
        "killed.log": "Experiment: d\n" + steps + "\r" + STEP.format(2, 2)[:40],
        "killed.1.log": "Experiment: d\n\r" + STEP.format(7, 7),
        "nameless.log": "Traceback\nImportError: torch\n",
    }
    for name, text in files.items():
        with open(os.path.join(path, name), "w", newline="") as f:
            f.write(text)
    got = {r.experiment_id: r for r in logs.read_summary(spark, path).collect()}
    assert {k: got[k].status for k in "abcd"} == {"a": "ok", "b": "crash", "c": "fail", "d": "killed"} and len(got) == 5
    assert (got["a"].val_bpb, got["a"].training_seconds, got["a"].num_steps, got["a"].depth, got["a"].mfu_percent) == (0.9979, 300.1, 2, 4, 39.8)
    assert got["b"].crash_message == "no: memory" and got["b"].val_bpb is None and not got["b"].crashed and got["d"].crashed
    assert {k: got[k].last_step for k in "abcd"} == {"a": 1, "b": 1, "c": 1, "d": 7}
    nameless = next(r for k, r in got.items() if k.endswith("nameless.log"))
    assert nameless.crashed and nameless.num_steps is None
    steps = sorted((r.experiment_id, r.step, r.tok_per_sec, r.loss) for r in logs.read_steps(spark, path).collect())
    assert steps == [(k, i, 65536, 1.5) for k in "abc" for i in (0, 1)] + [("d", i, 65536, 1.5) for i in (0, 1, 7)]


def test_rotated_logs(spark):
    lines = spark.createDataFrame([("r", i, STEP.format(i, i)) for i in range(25)] + [("s", 0, STEP.format(0, 0))], "experiment_id string, step int, line string")
    row = (1.0, 2.0, 3.0, 4.0, 50, 10, 4)
    summary = spark.createDataFrame([("r", 25, "ok", None, 0.5, *row), ("s", 1, "killed", None, None, *row), ("t", 0, "crash", "at start", None, *row)],
                                    "experiment_id string, num_steps long, how string, message string, val_bpb double, training_seconds double, total_seconds double, "
                                    "peak_vram_mb double, mfu_percent double, total_tokens long, num_params long, depth int")
    path = work_dir(spark, "t-rotated")
    logs.write_logs(lines, summary, path, steps_a_file=10)
    assert logs.read_lines(spark, path).select("file").distinct().count() == 5
    assert sorted(map(tuple, logs.read_steps(spark, path).groupBy("experiment_id").count().collect())) == [("r", 25), ("s", 1)]
    got = {r.experiment_id: (r.status, r.num_steps, r.last_step, r.crash_message) for r in logs.read_summary(spark, path).collect()}
    assert got == {"r": ("ok", 25, 24, None), "s": ("killed", None, 0, None), "t": ("crash", 0, None, "at start")}
