"""Schemas of the run registry and corpus tables, plus fixed constants.

Fixed values (must equal the behaviour being reproduced):
- summary metric names, in order: val_bpb, training_seconds, total_seconds, peak_vram_mb,
  mfu_percent, total_tokens, num_steps, num_params
- run status values: ok, fail, crash; rejected statuses: fail, crash
- results log statuses: keep, discard, crash
- page size: default 50, at least 1, at most 200; offset at least 0
- corpus split rows: val from 10,000 to 20,000, train from 20,000
- vocabulary size 1024 with 4 special tokens <|reserved_0|> .. <|reserved_3|>; BOS is <|reserved_0|>
- split pattern (GPT-4 style with digits in groups of at most two):
  '(?i:[sdmt]|ll|ve|re)|[^\\r\\n\\p{L}\\p{N}]?+\\p{L}+|\\p{N}{1,2}| ?[^\\s\\p{L}\\p{N}]++[\\r\\n]*|\\s*[\\r\\n]|\\s+(?!\\S)|\\s+
- sequence length 256, time budget 300 s (hard limit 600 s), evaluation tokens 65,536
- total batch 16,384 tokens, device batch 32, aspect ratio 64, head dim 128, window pattern L
- warm-up ratio 0.0, warm-down ratio 0.5, final rate fraction 0.0, weight decay 0.2
- momentum 0.85 to 0.95 over 300 steps; peak FLOP/s 989.5e12; EMA beta 0.9
- loss blow-up: NaN or above 100; steps 0..10 excluded from training time
- tokenizer sample: 200,000,000 characters, 10,000 per document; packing buffer 1,000 documents,
  refill batches of 128 documents
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)

# ---- fixed values -------------------------------------------------------------------------
SUMMARY_METRIC_KEYS = ("val_bpb", "training_seconds", "total_seconds", "peak_vram_mb",
                       "mfu_percent", "total_tokens", "num_steps", "num_params")
STATUS_OK = "ok"
REJECTED_STATUSES = ("fail", "crash")
LOG_STATUSES = ("keep", "discard", "crash")
PAGE_DEFAULT, PAGE_MIN, PAGE_MAX = 50, 1, 200

VAL_ROW_START, VAL_ROW_END, TRAIN_ROW_START = 10_000, 20_000, 20_000
VOCAB_SIZE = 1024
SPECIAL_TOKENS = ("<|reserved_0|>", "<|reserved_1|>", "<|reserved_2|>", "<|reserved_3|>")
BOS_TOKEN = "<|reserved_0|>"
SPLIT_PATTERN = (r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|"""
                 r"""\s*[\r\n]|\s+(?!\S)|\s+""")
# RE2-compatible pattern used when a query must also run on an RE2 engine
SIMPLE_SPLIT_PATTERN = r"\p{L}+|\p{N}{1,2}"

MAX_SEQ_LEN = 256
TIME_BUDGET = 300
HARD_TIME_LIMIT = 600
EVAL_TOKENS = 65_536
TOTAL_BATCH_SIZE = 2 ** 14
DEVICE_BATCH_SIZE = 32
ASPECT_RATIO = 64
HEAD_DIM = 128
WINDOW_PATTERN = "L"
WARMUP_RATIO, WARMDOWN_RATIO, FINAL_LR_FRAC = 0.0, 0.5, 0.0
WEIGHT_DECAY = 0.2
MOMENTUM_START, MOMENTUM_END, MOMENTUM_STEPS = 0.85, 0.95, 300
PEAK_FLOPS = 989.5e12
EMA_BETA = 0.9
LOSS_BLOWUP = 100.0
WARMUP_STEPS_EXCLUDED = 10
MAX_SAMPLE_CHARS, DOC_CHAR_CAP = 200_000_000, 10_000
PACK_BUFFER, DOC_BATCH = 1000, 128
VE_GATE_CHANNELS = 32

# ---- schemas ------------------------------------------------------------------------------
RESULT_SCHEMA = StructType([
    StructField("experiment_id", StringType()),
    StructField("git_commit", StringType()),
    StructField("git_dirty", BooleanType()),
    StructField("status", StringType()),
    StructField("crash_message", StringType()),
    StructField("val_bpb", DoubleType()),
    StructField("training_seconds", DoubleType()),
    StructField("total_seconds", DoubleType()),
    StructField("peak_vram_mb", DoubleType()),
    StructField("mfu_percent", DoubleType()),
    StructField("total_tokens", LongType()),
    StructField("num_steps", LongType()),
    StructField("num_params", LongType()),
    StructField("depth", IntegerType()),
    StructField("checkpoint_path", StringType()),
    StructField("configuration", StringType()),
    StructField("parent_experiment_id", StringType()),
])

CHECKPOINT_META = StructType([
    StructField("experiment_id", StringType()),
    StructField("git_commit", StringType()),
    StructField("git_dirty", BooleanType()),
    StructField("val_bpb", DoubleType()),
    StructField("depth", IntegerType()),
    StructField("num_params", LongType()),
    StructField("vocab_size", IntegerType()),
    StructField("max_seq_len", IntegerType()),
    StructField("window_pattern", StringType()),
])

RUN_COLUMNS = ("id", "experiment_id", "status", "git_commit", "git_dirty", "parent_experiment_id",
               "started_at", "completed_at", "duration_seconds", "val_bpb", "num_params", "depth",
               "vocab_size", "max_seq_len", "window_pattern", "checkpoint_path", "configuration",
               "crash_message", "created_at")
SUMMARY_COLUMNS = ("id", "experiment_id", "status", "git_commit", "git_dirty", "parent_experiment_id",
                   "val_bpb", "duration_seconds", "num_params", "depth", "vocab_size", "max_seq_len",
                   "window_pattern", "checkpoint_path", "created_at")
METRIC_COLUMNS = ("id", "experiment_uuid", "metric_name", "metric_value", "step", "recorded_at")
CHECKPOINT_COLUMNS = ("id", "experiment_uuid", "checkpoint_path", "metadata", "created_at")

# column length limits (V6)
LENGTH_LIMITS = {"experiment_id": 128, "parent_experiment_id": 128, "status": 32, "git_commit": 64,
                 "window_pattern": 32, "metric_name": 64}
NOT_NULL = ("experiment_id", "status")
# result fields that hold an object
JSON_FIELDS = ("configuration",)

VOCAB_SCHEMA = StructType([
    StructField("token_id", IntegerType(), False),
    StructField("bytes", BinaryType()),
    StructField("left", IntegerType()),
    StructField("right", IntegerType()),
    StructField("is_special", BooleanType()),
])

STEP_SCHEMA = StructType([
    StructField("experiment_id", StringType()),
    StructField("step", IntegerType()),
    StructField("loss", DoubleType()),
    StructField("dt", DoubleType()),
    StructField("vram_bytes", LongType()),
])

PACKED_SCHEMA = StructType([
    StructField("shard", IntegerType()),
    StructField("row_no", LongType()),
    StructField("epoch", IntegerType()),
    StructField("tokens", ArrayType(IntegerType())),
    StructField("cropped", LongType()),
    StructField("complete", BooleanType()),
    StructField("docs_in", LongType()),
    StructField("tokens_in", LongType()),
])

TS = TimestampType()
