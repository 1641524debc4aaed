"""Python workers take large Arrow batches in steps, with the results of whole batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runloom.operators import bpb, bpe, packing


def test_encoders_take_a_batch_in_steps():
    texts = [f"word{i} añ " * 40_000 for i in range(8)] + [None, "", "x"]
    out = list(bpe._encoded(bpe._byte_ids, 256, iter([pa.array(texts)])))
    assert len(out) >= 4 and all(len(c.flatten()) <= bpe.STEP_ITEMS + 11 for c in out)
    assert [t for c in out for t in c.to_pylist()] == [None if t is None else [256, *t.encode()] for t in texts]
    words = [[f" w{i % 7}"] * 300_000 for i in range(6)] + [None, []]
    rows = bpe.vocab_rows([(256, 32, ord("w"), 9)])
    out = list(bpe._encoded(bpe._word_ids(rows), None, iter([pa.array(words)])))
    assert len(out) == 2
    got = [t for c in out for t in c.to_pylist()]
    assert got[-2:] == [None, []] and all(got[i] == [256, ord("0") + i] * 300_000 for i in range(6))


def test_packed_rows_come_in_small_batches_and_null_texts_are_empty_documents(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [256, *rng.integers(0, 255, 40).tolist()]) for i in range(3_000)] + [(3_000, None)]
    sent = pa.RecordBatch.from_arrays([pa.array([0] * 3_001, pa.int32()), pa.array([1] * 3_001, pa.int32()), pa.array([t for _, t in docs], pa.list_(pa.int32()))],
                                      names=["shard", "epoch", "tokens"])
    out = list(packing._pack_partitions(33, 100, 16)(iter([sent])))
    assert len(out) > 5 and max(b.num_rows for b in out) <= packing.PACK_STEP
    frame = spark.createDataFrame(docs, "pos long, tokens array<int>")
    r = packing.packing_report(packing.pack_ranges(frame, 32, range_docs=500, buffer_size=100, batch=16), 32, 256).first()
    assert (r.docs_in, r.tokens_in, r.balance_gap, r.bad_length_rows) == (3_001, 3_000 * 41, 0, 0)


def test_token_counts_of_long_batches(spark):
    texts = [("a" * 700_000 + "b" * 10, "en"), ("b" * 700_000, None), (None, "en"), ("ab", "de")]
    enc = bpe.encode_docs(spark.createDataFrame(texts, "text string, lang string").coalesce(1), bpe.vocab_rows([]), 256, keep=("lang",))
    got = {(r.lang, r.token_id): r.n for r in bpb.count_tokens(enc, ("lang",)).collect()}
    assert got == {("en", 97): 700_000, ("en", 98): 10, ("en", 256): 1, (None, 98): 700_000, (None, 256): 1, ("de", 97): 1, ("de", 98): 1, ("de", 256): 1}
    assert enc.where(F.col("tokens").isNull()).count() == 1
