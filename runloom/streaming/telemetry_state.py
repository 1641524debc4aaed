"""M3, M4, M5: the always-fresh overview, per-run carried state over step telemetry, and the
early failure signal, as Structured Streaming queries.

M4 keeps in the state store, per run: smoothed loss, best debiased loss so far, training time, the step expected next,
the stop (W8, P14), and the steps that arrived before the one expected. Those wait until the gap closes, so deliveries may
come in any order and late: the output equals the batch operators (W3, W4, W8) once all steps are there. Rows are taken
from the micro-batch piece by piece; what is held is what waits. ``gap_timeout`` gives a gap up after that time: the
waiting steps go on, and a step that comes even later is put out as `late` without values, never dropped. A step delivered
again changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from runloom.operators import registry as reg
from runloom.operators import telemetry as tel
from runloom.schemas import EMA_BETA, LOSS_BLOWUP, STEP_SCHEMA, TIME_BUDGET, WARMUP_STEPS_EXCLUDED

EMA_OUT = StructType([StructField("experiment_id", StringType()), StructField("step", IntegerType()),
                      StructField("smooth_loss", DoubleType()), StructField("ema_loss", DoubleType()),
                      StructField("training_time", DoubleType()), StructField("best_loss", DoubleType()),
                      StructField("stop_reason", StringType()), StructField("after_stop", BooleanType()), StructField("late", BooleanType())])
EMA_STATE = StructType([StructField("s", DoubleType()), StructField("best", DoubleType()), StructField("t", DoubleType()),
                        StructField("expected", LongType()), StructField("stop", StringType()),
                        StructField("steps", ArrayType(LongType())), StructField("losses", ArrayType(DoubleType())),
                        StructField("dts", ArrayType(DoubleType())), StructField("skipped", ArrayType(LongType()))])


class RunState:
    """The carried variables of one run."""

    def __init__(self, held: tuple | None = None, budget: float = TIME_BUDGET):
        self.s, self.best, self.t, self.expected, self.stop = (0.0, math.inf, 0.0, 0, None) if held is None else held[:5]
        steps, losses, dts, skipped = ([], [], [], []) if held is None else held[5:]
        self.s = math.nan if self.s is None else self.s  # NaN is null on its way through Arrow
        self.waiting = {int(k): (math.nan if x is None else x, dt) for k, x, dt in zip(steps, losses, dts, strict=True)}
        self.skipped = {int(k) for k in skipped}  # given up, not arrived yet
        self.budget = budget

    def held(self) -> tuple:
        steps = sorted(self.waiting)
        return (self.s, self.best, self.t, self.expected, self.stop, steps, [self.waiting[k][0] for k in steps],
                [self.waiting[k][1] for k in steps], sorted(self.skipped))

    def take(self, step: int, loss: float, dt: float) -> list[tuple]:
        """A delivered step: the rows that it sets free."""
        if step in self.skipped:
            self.skipped.remove(step)
            return [(step, None, None, None, None, None, None, True)]
        if step >= self.expected:
            self.waiting.setdefault(step, (loss, dt))
        return self._advance()

    def give_up(self) -> list[tuple]:
        """The first gap is given up: the rows behind it, up to the next gap."""
        if not self.waiting:
            return []
        first = min(self.waiting)
        self.skipped |= set(range(self.expected, first))
        self.expected = first
        return self._advance()

    def _advance(self) -> list[tuple]:
        out = []
        while self.expected in self.waiting:
            step = self.expected
            loss, dt = self.waiting.pop(step)
            after = self.stop is not None
            self.s = EMA_BETA * self.s + (1.0 - EMA_BETA) * loss
            if step > WARMUP_STEPS_EXCLUDED:
                self.t += dt
            ema = self.s / (1.0 - EMA_BETA ** (step + 1))
            if ema < self.best:
                self.best = ema
            reason = None
            if not after and (math.isnan(loss) or loss > LOSS_BLOWUP):
                reason = "fail"
            elif not after and step >= WARMUP_STEPS_EXCLUDED and self.t >= self.budget:
                reason = "time"
            self.stop = self.stop or reason
            out.append((step, self.s, ema, self.t, None if math.isinf(self.best) else self.best, reason, after, False))
            self.expected += 1
        return out


def _ema_state(budget: float, gap_timeout_ms: int | None):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [f.name for f in EMA_OUT.fields]
        now = RunState(tuple(state.get) if state.exists else None, budget)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

        if state.hasTimedOut:
            yield frame(now.give_up())
        for pdf in pdfs:
            rows: list[tuple] = []
            pdf = pdf.sort_values("step")
            for step, loss, dt in zip(pdf["step"].tolist(), pdf["loss"].tolist(), pdf["dt"].tolist(), strict=True):
                rows += now.take(int(step), math.nan if loss is None else float(loss), float(dt or 0.0))
            yield frame(rows)
        state.update(now.held())
        if gap_timeout_ms is not None and now.waiting:
            state.setTimeoutDuration(gap_timeout_ms)
    return run


def steps_stream(spark: SparkSession, source: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(source)


def start_loss_ema(spark: SparkSession, source: str, sink: str, checkpoint: str, budget: float = TIME_BUDGET, gap_timeout_ms: int | None = None,
                   max_files: int = 1):
    """M4: keyed state per run (``applyInPandasWithState``), appended to a parquet sink."""
    s = steps_stream(spark, source, max_files)
    wait = GroupStateTimeout.NoTimeout if gap_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = s.groupBy("experiment_id").applyInPandasWithState(_ema_state(budget, gap_timeout_ms), EMA_OUT, EMA_STATE, "append", wait)
    nan = {c: F.when(~F.col("late"), F.coalesce(F.col(c), F.lit(float("nan")))) for c in ("smooth_loss", "ema_loss")}
    out = out.withColumns(nan)
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def start_failures(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """M5: blow-up steps (NaN or loss above 100) filtered on the stream, append mode."""
    s = steps_stream(spark, source)
    out = s.where(tel.blowup(F.col("loss"))).select("experiment_id", "step", "loss")
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def start_overview(spark: SparkSession, runs_path: str, sink: str, checkpoint: str):
    """M3: the A6 overview, counted anew over the registry's runs whenever files arrive: a batch that is written again
    replaces its own rows there, so a replay changes nothing. Each trigger replaces the one-row result table."""
    schema = spark.read.parquet(runs_path).schema
    arrivals = spark.readStream.schema(schema).parquet(runs_path)

    def write(df, _bid):
        reg.overview(df.sparkSession.read.schema(schema).parquet(runs_path)).write.mode("overwrite").parquet(sink)
    q = (arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
