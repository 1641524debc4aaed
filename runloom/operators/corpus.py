"""Corpus preparation: positional split, character budget, document batches, epoch repeat and
the synthetic story corpus (S8, W1, W2, W6, F20, U2, V7).

Row order carries meaning, so every document has an explicit unique ``doc_id`` and positions are
ranks of it computed in two levels (``runloom.operators.ordered``): never one global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.checks import corpus_size_guard
from runloom.operators.ordered import prefix_agg, with_position
from runloom.schemas import DOC_BATCH, DOC_CHAR_CAP, MAX_SAMPLE_CHARS, TRAIN_ROW_START, VAL_ROW_END, VAL_ROW_START

# The synthetic story template and its four animals, in order.
STORY_ANIMALS = ("cat", "dog", "bird", "fox")
STORY_TEMPLATE = ("Once upon a time there was a little {animal} named Buddy{number}. "
                  "The friends played in the garden and learned to share. They were happy. The end.")


def split_bounds(n_rows: int, val_start: int = VAL_ROW_START, val_end: int = VAL_ROW_END,
                 train_start: int = TRAIN_ROW_START) -> dict[str, int]:
    """W1 bounds clamped to the table size."""
    ve = min(val_end, n_rows)
    vs = min(val_start, ve)
    ts = min(train_start, n_rows)
    return {"val_start": vs, "val_end": ve, "train_start": ts, "n_rows": n_rows}


def split_corpus(docs: DataFrame, bounds: dict[str, int], order_col: str = "doc_id",
                 guard: bool = True) -> DataFrame:
    """Rows before ``val_start`` (test) are dropped; [val_start, val_end) is val; from
    ``train_start`` on is train. Adds ``pos`` and ``pos_in_split``."""
    if guard:
        corpus_size_guard(bounds["n_rows"], bounds["train_start"])  # V7
    d = with_position(docs, order_col=order_col, out="pos")
    vs, ve, ts = bounds["val_start"], bounds["val_end"], bounds["train_start"]
    in_val = (F.col("pos") >= vs) & (F.col("pos") < ve)
    in_train = F.col("pos") >= ts
    d = d.where(in_val | in_train)
    split = F.when(in_train, F.lit("train")).otherwise(F.lit("val"))
    pos_in = F.when(in_train, F.col("pos") - ts).otherwise(F.col("pos") - vs)
    return d.withColumn("split", split).withColumn("pos_in_split", pos_in.cast("long"))


def capped(text: str = "text", doc_cap: int = DOC_CHAR_CAP):
    """the first ``doc_cap`` characters."""
    return F.substring(text, 1, doc_cap)


def char_budget(docs: DataFrame, max_chars: int = MAX_SAMPLE_CHARS, doc_cap: int = DOC_CHAR_CAP,
                order_col: str = "pos_in_split", width: int = 4096) -> DataFrame:
    """W2 + F20: documents in order until the running total of capped lengths reaches the budget;
    the document that crosses the budget is kept. ``docs`` has a length ``n_chars`` (and then needs no text here), or
    the text, which then travels with the running sum."""
    n = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    d = docs.withColumn("capped_len", F.least(n, F.lit(doc_cap)).cast("long"))
    d = prefix_agg(d, order_col=order_col, value="capped_len", how="sum", out="cum_chars", width=width)
    return d.withColumn("kept", (F.col("cum_chars") - F.col("capped_len")) < F.lit(max_chars))


def budget_texts(docs: DataFrame, max_chars: int = MAX_SAMPLE_CHARS, doc_cap: int = DOC_CHAR_CAP) -> DataFrame:
    """The capped texts within the budget, in the order of ``doc_id``: the running total is monotone, so the last kept
    id (one row) is found from lengths and the texts are then filtered by it."""
    sizes = docs.select("doc_id", F.length("text").alias("n_chars"))
    last = char_budget(sizes, max_chars, doc_cap, order_col="doc_id").where("kept").agg(F.max("doc_id").alias("id")).first()["id"]
    return docs.where(F.col("doc_id") <= F.lit(last)).withColumn("capped_text", capped("text", doc_cap))


def doc_batches(split_docs: DataFrame, batch: int = DOC_BATCH) -> DataFrame:
    """Consecutive batches of ``batch`` documents within a split."""
    return split_docs.withColumn("batch_no", F.floor(F.col("pos_in_split") / batch).cast("long"))


def epoch_stream(split_docs: DataFrame, epochs: int) -> DataFrame:
    """The corpus repeated once per epoch (epochs numbered from 1), as a generator column."""
    return split_docs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))


def smoke_stories(positions: DataFrame, seed_col: str = "seed", index_col: str = "pos_in_split") -> DataFrame:
    """One synthetic story per row: animal by ``index % 4``, name number ``seed + index``."""
    i = F.col(index_col)
    animal = F.element_at(F.array(*[F.lit(a) for a in STORY_ANIMALS]), (i % 4 + 1).cast("int"))
    head, rest = STORY_TEMPLATE.split("{animal}")
    mid, tail = rest.split("{number}")
    text = F.concat(F.lit(head), animal, F.lit(mid), (F.col(seed_col) + i).cast("string"), F.lit(tail))
    return positions.withColumn("text", text)
