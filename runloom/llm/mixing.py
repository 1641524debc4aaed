"""Mixing sources to target weights (operator 7): a low-discrepancy source schedule.

Slot k of the schedule is the point frac((k + 0.5) * golden ratio); the source whose interval of cumulative target
shares holds the point owns the slot. Slots are ranked per source, and the r-th slot of a source takes the r-th of
its blocks: the source's documents in a shuffled order (by md5 of the id) laid end to end and repeated as often as
its target asks, cut into blocks of equal numbers of tokens (they differ by one at most). Schedule rows tell which
words of which document fill which slot.

Nothing per document or per slot goes through one task: orders and ranks come from chunks of bounded size, and only
one row per source and chunk is summed over a source. The table of sources is one small window.

Cases: a null text has size 0 and takes nothing; a null source is a source of its own, after all others; documents of
equal md5 keep the order of their ids; repeated rows of a document are laid end to end and each gets its own part;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.llm.catalog import query
from runloom.llm.common import WORD, read, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_TOKENS = 256
CHUNK_ROWS = 20_000
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which points and sources are joined.
CELLS = 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> source, source_size, target. Sources by code point, null last, weigh `weights` in turn
    and share the sum of all sizes; no target is above `most` times its source's size, the excess is shared anew by
    weight. In order of cap per weight, the capped sources are a prefix: one window over the sources."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), "rank")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    rest = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = ((F.sum("source_size").over(W.partitionBy(F.lit(1))) - F.coalesce(F.sum("cap").over(past), F.lit(0))).cast("double")
             / F.sum("w").over(rest).cast("double"))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("cap").cast("double") > F.col("w") * F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("o"), "rank", "level"))).over(W.partitionBy(F.lit(1)))
    return leveled.withColumn("first", first).select(
        "source", "source_size", "rank",
        F.when(F.col("first").isNull() | (F.struct((F.col("cap") / F.col("w")).alias("o"), "rank") < F.struct("first.o", "first.rank")),
               F.col("cap").cast("double")).otherwise(F.col("w") * F.col("first.level")).alias("target"))


def placed(sized: DataFrame) -> DataFrame:
    """(doc_id, rank, size, ...) -> the same with start: words of its source before the document in shuffled order."""
    chunks = max(1, -(-sized.count() // CHUNK_ROWS))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = sized.withColumn("k", key).withColumn("c", F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * chunks).cast("long"))
    sums = keyed.groupBy("rank", "c").agg(F.sum("size").alias("s"))
    past = W.unboundedPreceding, -1
    before = sums.select("rank", "c", F.coalesce(F.sum("s").over(W.partitionBy("rank").orderBy("c").rowsBetween(*past)), F.lit(0)).alias("before"))
    inner = W.partitionBy("rank", "c").orderBy("k", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(*past)
    run = keyed.withColumn("part", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return run.join(before, ["rank", "c"]).withColumn("start", F.col("part") + F.col("before")).drop("k", "c", "part", "before")


def schedule(spark: SparkSession, plan: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """plan (source, source_size, rank, target) -> one row per slot: slot, rank, lo, hi. The slot takes the words
    [lo, hi) of its source's repeated sequence; the slots of a source take floor(target) words. A source with a target
    that no point falls on gets one slot after the others."""
    order = W.orderBy("rank")
    all_rows = W.partitionBy(F.lit(1))
    shares = plan.select("rank", F.floor("target").cast("long").alias("take")).where("take > 0")
    shares = shares.withColumn("to", F.sum("take").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("take").over(all_rows))
    shares = shares.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0.0)))
    slots = -(-int(plan.agg(F.sum(F.floor("target"))).first()[0] or 0) // block)
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("long")
    celled = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))))
    point = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", cell(F.col("u")))
    owned = points.join(celled, "cell").where("u >= `from` and u < `to`").select("slot", "rank", "take")
    unheard = shares.join(owned.select("rank").distinct(), "rank", "left_anti").select((F.col("rank") + slots).alias("slot"), "rank", "take")
    owned = owned.unionByName(unheard).withColumn("c", F.floor(F.col("slot") / CHUNK_ROWS))
    counts = owned.groupBy("rank", "c").agg(F.count("*").alias("n"))
    by = W.partitionBy("rank").orderBy("c")
    counts = counts.select("rank", "c", F.sum("n").over(W.partitionBy("rank")).alias("n"),
                           F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("rank", "c").orderBy("slot")) - 1
    ranked = owned.withColumn("in_chunk", place).join(counts, ["rank", "c"]).withColumn("r", F.col("in_chunk") + F.col("before"))
    whole = F.expr("r * (take div n) + (r * (take % n)) div n")  # floor(r * take / n) without overflow
    return ranked.select("slot", "rank", whole.alias("lo"),
                         F.expr("(r + 1) * (take div n) + ((r + 1) * (take % n)) div n").alias("hi"))


def spans(docs: DataFrame, slots: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """docs (rank, start, size, source_size, target, ...) and slots -> (slot, rank, start, pass_no, word_lo, word_hi):
    which words of the document at `start` of its source fill which slot, on which pass over the source. Both sides
    are cut into cells of `block` words of the repeated sequence; a pair counts in the cell where its overlap begins."""
    doc = docs.where("size > 0 and target >= 1").select(
        "rank", "start", "size", F.explode(F.sequence(F.lit(0), F.expr("cast((floor(target) - 1) div source_size as int)"))).alias("pass_no"), "source_size")
    doc = doc.withColumn("a", F.col("pass_no") * F.col("source_size") + F.col("start"))
    doc = doc.select("rank", "start", "pass_no", "a", (F.col("a") + F.col("size")).alias("b"))
    celled = lambda df, a, b: df.withColumn("cell", F.explode(F.sequence(F.expr(f"{a} div {block}"), F.expr(f"({b} - 1) div {block}"))))
    met = celled(doc, "a", "b").join(celled(slots.where("hi > lo"), "lo", "hi"), ["rank", "cell"])
    low, high = F.greatest("a", "lo"), F.least("b", "hi")
    return met.where((low < high) & (F.expr(f"greatest(a, lo) div {block}") == F.col("cell"))).select(
        "slot", "rank", "start", "pass_no", (low - F.col("a")).alias("word_lo"), (high - F.col("a")).alias("word_hi"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """documents -> (one row per document with size, source_size, target, taken; the schedule's rows, see spans())."""
    sized = written(docs.select("doc_id", "source", words().alias("size")), "mix-sizes")
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-plan")
    p = plan.withColumnRenamed("source", "ps")
    known = sized.join(p, sized.source.eqNullSafe(p.ps)).drop("ps")
    laid = written(placed(known), "mix-laid")
    rows = written(spans(laid, schedule(docs.sparkSession, plan, block), block), "mix-schedule")
    taken = rows.groupBy("rank", "start").agg(F.sum(F.col("word_hi") - F.col("word_lo")).alias("taken"))
    t = taken.withColumnsRenamed({"rank": "tr", "start": "ts"})
    out = laid.join(t, (laid.rank == t.tr) & (laid.start == t.ts) & (laid["size"] > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "rank", "start"), rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words, word_lo, word_hi) -> the rows, each text cut to its words [word_lo, word_hi); whole texts stay as they are."""
    for batch in batches:
        row = batch.column("row")
        names = [f.name for f in row.type]
        columns = dict(zip(names, row.flatten(), strict=True))
        texts = columns["text"].to_pylist()
        for i, (lo, hi, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("word_lo", "word_hi", "words")), strict=True)):
            if lo or hi < size:
                found = list(re.finditer(WORD, texts[i]))
                texts[i] = texts[i][found[lo].start():found[hi - 1].end()]
        columns["text"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_TOKENS) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each document and pass that the schedule takes it in, its text
    cut to the words taken. n_chars, where docs has it, is that of the row's text. Rows of one id, source and size that
    differ are told apart by their text; rows equal in these are copies."""
    of_doc, rows = mix(docs, weights, most, block)
    part = rows.groupBy("rank", "start", "pass_no").agg(F.min("word_lo").alias("word_lo"), F.max("word_hi").alias("word_hi"))
    taken = of_doc.where("size > 0").join(part, ["rank", "start"]).select("doc_id", "source", "size", "start", "pass_no", "word_lo", "word_hi")
    # the i-th of several rows of one (id, source, size) goes with the i-th place of it in the shuffled order
    place = W.partitionBy("doc_id", "source", "size")
    at = taken.withColumn("i", F.dense_rank().over(place.orderBy("start"))).select(
        F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s")).alias("k"), F.col("size").alias("m"), "i", "pass_no", "word_lo", "word_hi")
    # the documents' own columns travel as one struct: names of theirs can't clash with ours
    key = F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"))
    own = docs.select(F.struct(*docs.columns).alias("row"), key.alias("own"), words().alias("words"), F.xxhash64("text").alias("h")).where("words > 0")
    own = own.withColumn("nth", F.row_number().over(W.partitionBy("own", "words").orderBy("h")))
    joined = own.join(at, F.col("own").eqNullSafe(F.col("k")) & (F.col("words") == F.col("m")) & (F.col("nth") == F.col("i")))
    cut = joined.select("row", "words", "word_lo", "word_hi").mapInArrow(_cut, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM src),
weighed AS (SELECT *, [5, 2, 1][(rk % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM ranked),
leveled AS (SELECT *, ((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
first_open AS (SELECT arg_min(level, (cap / w, rk)) AS level, min((cap / w, rk)) AS k FROM leveled WHERE cap::DOUBLE > w * level),
planned AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR (cap / w, rk) < f.k THEN cap::DOUBLE ELSE w * f.level END AS target FROM leveled l, first_open f),
laid AS (SELECT d.doc_id, d.size, p.source_size, p.target,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  floor(p.target)::BIGINT AS take FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 OR source_size = 0 THEN 0 ELSE
  (take // source_size) * size + greatest(0, least(size, take % source_size - start)) END::BIGINT AS taken FROM laid
"""


@query("op7_mix_sources", ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")
