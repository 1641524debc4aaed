"""Bits per byte (J7, A7) over a token-loss table ``(doc_id, pos, token_id, nats)``.

bpb = sum(nats of tokens with a byte length > 0) / (ln 2 * sum(byte lengths)); special tokens
(byte length 0) drop out of both sums. The byte-length table is at most the vocabulary size, so
it is broadcast; everything else is a partial + final aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from runloom.operators.bpe import slices


def explode_tokens(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_pos: bool = True) -> DataFrame:
    if with_pos:
        return encoded.select(*keep, F.posexplode("tokens").alias("pos", "token_id"))
    return encoded.select(*keep, F.explode("tokens").alias("token_id"))


def count_tokens(encoded: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """(group..., token_id, n) over token arrays. Each step of an Arrow batch is counted as a whole before any row is made, so a
    step gives at most (its groups x vocabulary) rows, however long its documents are, and holds about STEP_ITEMS tokens."""
    fields = [encoded.schema[c] for c in group_cols]
    schema = StructType([*fields, StructField("token_id", IntegerType()), StructField("n", LongType())])

    def counted(batches):
        for batch in slices(batches, "tokens"):
            tokens = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            group = np.zeros(batch.num_rows, dtype=np.int64)
            if group_cols:
                frame = batch.select(list(group_cols)).to_pandas()
                group = frame.groupby(list(group_cols), dropna=False, sort=False).ngroup().to_numpy()
            keys, n = np.unique((np.repeat(group, sizes) << 32) | tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                return_counts=True)
            ids, first = np.unique(group, return_index=True)
            row = pa.array(first[np.searchsorted(ids, keys >> 32)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in group_cols), pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                                              pa.array(n.astype(np.int64))], names=[*group_cols, "token_id", "n"])

    return (encoded.select(*group_cols, "tokens").mapInArrow(counted, schema)
            .groupBy(*group_cols, "token_id").agg(F.sum("n").alias("n")))


def unigram_losses(encoded: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Our own test feed (not a scorer of the reference): nats = -ln(count(token) / all tokens).
    Returned pre-aggregated as (group..., token_id, n, nats): the loss depends on the token only."""
    per = count_tokens(encoded, group_cols)
    # `per` has at most (groups x vocabulary) rows: token totals and the grand total are windows over
    # it, so the token stream is aggregated once and never joined back
    c = F.sum("n").over(Window.partitionBy("token_id"))
    total = F.sum("n").over(Window.partitionBy())
    return per.withColumn("nats", -F.log(c / total))


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame, group_cols: tuple[str, ...] = (),
                  weight: str | None = None) -> DataFrame:
    """A7 (+ J7 broadcast join on token_id). ``losses`` is one row per token, or pre-aggregated rows
    with an occurrence count in ``weight``."""
    j = losses.join(F.broadcast(token_bytes), "token_id", "left")
    nb = F.coalesce(F.col("n_bytes"), F.lit(0))
    w = F.col(weight) if weight else F.lit(1)
    agg = j.groupBy(*group_cols).agg(
        F.sum(F.when(nb > 0, F.col("nats") * w).otherwise(F.lit(0.0))).alias("total_nats"),
        F.sum(nb * w).cast("long").alias("total_bytes"))
    return agg.withColumn("bpb", F.col("total_nats") / (F.lit(math.log(2)) * F.nullif(F.col("total_bytes"), F.lit(0))))
