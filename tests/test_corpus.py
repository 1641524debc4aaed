import pytest
from pyspark.sql import functions as F

from runloom.operators import corpus as cp


def docs(spark, lengths, gap=3):
    rows = [(i * gap, "x" * n) for i, n in enumerate(lengths)]   # ids with gaps: position != id
    return spark.createDataFrame(rows, "doc_id LONG, text STRING")


def test_split_bounds_are_clamped_and_guarded(spark):
    b = cp.split_bounds(25, 10, 20, 20)
    assert b == {"val_start": 10, "val_end": 20, "train_start": 20, "n_rows": 25}
    b = cp.split_bounds(15, 10, 20, 20)
    assert (b["val_start"], b["val_end"], b["train_start"]) == (10, 15, 15)
    with pytest.raises(ValueError):
        cp.split_corpus(docs(spark, [1] * 15), b)                  # V7: not more rows than train start
    s = cp.split_corpus(docs(spark, [1] * 25), cp.split_bounds(25, 10, 20, 20), guard=True)
    got = {r.pos: (r.split, r.pos_in_split) for r in s.collect()}
    assert sorted(got) == list(range(10, 25))                       # rows 0-9 (test) dropped
    assert got[10] == ("val", 0) and got[19] == ("val", 9) and got[20] == ("train", 0)


def test_char_budget_keeps_the_crossing_document(spark):
    d = cp.split_corpus(docs(spark, [4, 5, 6, 20000, 3]), cp.split_bounds(5, 0, 0, 0))
    b = {r.doc_id: (r.capped_len, r.cum_chars, r.kept) for r in cp.char_budget(d, max_chars=10, doc_cap=10000).collect()}
    assert b[0] == (4, 4, True) and b[3] == (5, 9, True)
    assert b[6] == (6, 15, True)            # crosses the budget: kept
    assert b[9] == (10000, 10015, False)    # capped at 10,000 characters, after the budget
    assert b[12][2] is False
    t = {r.doc_id: len(r.capped_text) for r in cp.budget_texts(d, max_chars=10, doc_cap=5).collect()}
    assert t == {0: 4, 3: 5, 6: 5}           # the texts up to the crossing document, capped


def test_batches_and_epochs(spark):
    d = cp.split_corpus(docs(spark, [1] * 300), cp.split_bounds(300, 0, 0, 0))
    nb = {r.batch_no for r in cp.doc_batches(d, 128).collect()}
    assert nb == {0, 1, 2}
    e = cp.epoch_stream(d, 3)
    assert e.count() == 900 and {r.epoch for r in e.select("epoch").distinct().collect()} == {1, 2, 3}


def test_smoke_stories(spark):
    pos = spark.range(5).select(F.col("id").alias("pos_in_split"), F.lit(10000).alias("seed"))
    t = [r.text for r in cp.smoke_stories(pos).orderBy("pos_in_split").collect()]
    assert t[1].startswith("Once upon a time there was a little dog named Buddy10001.")
    assert "fox" in t[3] and "cat" in t[4]
