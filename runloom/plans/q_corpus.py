"""Registered queries: corpus split, sampling budget, batches, epochs and the story corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import corpus as cp
from runloom.plans import standins as st
from runloom.plans.catalog import query

# Stand-in bounds scale with the table: 10 % test, 10 % val, the rest train.
BUDGET_CHARS = 1_000_000


def bounds_for(n: int) -> dict[str, int]:
    return cp.split_bounds(n, val_start=n // 10, val_end=n // 5, train_start=n // 5)


def split_docs(spark, d):
    docs = st.stories(spark, d)
    n = docs.count()
    return cp.split_corpus(docs, bounds_for(n))


def train_docs(spark, d):
    """The documents of the train split by the id it starts at: ids alone are numbered, texts stay where they were read."""
    first = split_docs(spark, d).where("split = 'train' and pos_in_split = 0").select("doc_id").first()
    return st.stories(spark, d).where(F.col("doc_id") >= first["doc_id"])


SPLIT_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT doc_id, text, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
        (SELECT least(n // 10, least(n // 5, n)) FROM n) AS vs, (SELECT least(n // 5, n) FROM n) AS ve,
        (SELECT least(n // 5, n) FROM n) AS ts FROM documents),
s AS (SELECT doc_id, text, lang, source, pos, CASE WHEN pos >= ts THEN 'train' ELSE 'val' END AS split,
        CASE WHEN pos >= ts THEN pos - ts ELSE pos - vs END AS pos_in_split
      FROM p WHERE (pos >= vs AND pos < ve) OR pos >= ts)
"""


@query("corpus_split", "W1 V7", SPLIT_SQL + "SELECT doc_id, pos, split, pos_in_split FROM s")
def corpus_split(spark, d):
    return split_docs(spark, d).select("doc_id", "pos", "split", "pos_in_split")


@query("char_budget", "W2 F20", SPLIT_SQL + f"""
SELECT doc_id, capped_len, cum_chars, cum_chars - capped_len < {BUDGET_CHARS} AS kept, length(capped_text) AS capped_text_len
FROM (SELECT doc_id, CAST(least(length(text), 10000) AS BIGINT) AS capped_len, substr(text, 1, 10000) AS capped_text,
        CAST(sum(least(length(text), 10000)) OVER (ORDER BY pos_in_split ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_chars
      FROM s WHERE split = 'train') t""")
def char_budget(spark, d):
    # lengths are taken where the text is read: no text passes a shuffle
    docs = train_docs(spark, d).select("doc_id", F.length("text").alias("n_chars"), F.length(cp.capped("text")).alias("capped_text_len"))
    b = cp.char_budget(docs, max_chars=BUDGET_CHARS, order_col="doc_id")
    return b.select("doc_id", "capped_len", "cum_chars", "kept", "capped_text_len")


@query("doc_batches", "W6", SPLIT_SQL + "SELECT doc_id, split, CAST(pos_in_split // 128 AS BIGINT) AS batch_no FROM s")
def doc_batches(spark, d):
    return cp.doc_batches(split_docs(spark, d)).select("doc_id", "split", "batch_no")


@query("epoch_stream", "U2", SPLIT_SQL + """
SELECT doc_id, unnest(range(1, 3)) AS epoch, pos_in_split FROM s WHERE split = 'val'""")
def epoch_stream(spark, d):
    v = split_docs(spark, d).where(F.col("split") == "val")
    return cp.epoch_stream(v, 2).select("doc_id", F.col("epoch").cast("long").alias("epoch"), "pos_in_split")


@query("smoke_corpus", "S8", SPLIT_SQL + """
SELECT doc_id, split, 'Once upon a time there was a little ' || CASE pos_in_split % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog'
  WHEN 2 THEN 'bird' ELSE 'fox' END || ' named Buddy' || CAST(CASE WHEN split = 'train' THEN 0 ELSE 10000 END + pos_in_split AS VARCHAR)
  || '. The friends played in the garden and learned to share. They were happy. The end.' AS text
FROM s""")
def smoke_corpus(spark, d):
    s = split_docs(spark, d).withColumn("seed", F.when(F.col("split") == "train", F.lit(0)).otherwise(F.lit(10000)))
    return cp.smoke_stories(s).select("doc_id", "split", "text")
