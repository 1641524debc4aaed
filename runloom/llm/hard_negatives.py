"""Hard-negative mining (operator 12): an inverted multi-index, searched with certified windows.

Vectors become integers floor(256 x). Two codebooks, one for each half of the dimensions, are fitted on a bounded sample
(SAMPLE rows by hash of the id); all rows are indexed: a row's cell is its pair of nearest half-centres. For an anchor a
and half-centre c of radius r the half-score of every member is at most a.c + |a| r, so a cell's score is at most the
sum of its two half-bounds. A multi-sequence heap gives cells by falling sum without sorting all pairs. A search stops
as soon as the next bound shows that no unseen row can enter its result (a certified window); ties are searched on.

Index blocks are runs of neighbouring cells of at most BLOCK rows; a larger cell is cut by hash. Anchors travel to the
blocks that their bounds ask for, ANCHORS of them to a task: first to those with their best cells, which gives a fifth
positive to beat; then to the blocks that may still hold a better one; then, positives being exact, to the blocks with
a cell whose scores may lie in one of their windows. A task returns 5 rows an anchor or 10 a window at most.

Bounds hold in any data, but they exclude little where the halves of the vectors have no clusters: then nearly
every anchor visits every block (work: anchors x rows, in blocks). See the README for figures.

Cases: rows whose id, label or vector is null, whose vector is empty, holds a null or non-finite component or one of magnitude 2^18
or more (integers of 2^26, whose scores could pass 64 bits) take no part; rows are compared within one number of dimensions;
repeated rows count as rows of their own (an anchor's copy may be its positive), equal ids and scores being alike in the
result; a positive without a row in its window gives none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.catalog import query
from runloom.llm.common import read, written

POSITIVES, NEGATIVES = 5, 10
#: 30 * positive <= 100 * negative <= 90 * positive
WINDOW = (30, 90)
CENTRES, SAMPLE, STEPS = 16, 20_000, 10
BLOCK, ANCHORS = 16_384, 4_096
#: Rows in the cells that an anchor visits first.
SEED = 1_000
LIMIT = 1 << 26
NONE = -(1 << 62)


class Index(NamedTuple):
    """Half-centres, and for every cell: its codes, its radii, its number of rows, its first block, its blocks."""
    left: np.ndarray
    right: np.ndarray
    cells: np.ndarray  # code 1, code 2
    radii: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    pieces: np.ndarray


def fit(x: np.ndarray, centres: int = CENTRES, steps: int = STEPS) -> np.ndarray:
    """k-means of the rows of x from distinct rows of it; the same for the same rows."""
    distinct = np.unique(x, axis=0)
    middle = distinct[np.random.default_rng(12).permutation(len(distinct))[:centres]].astype(np.float64)
    for _ in range(steps):
        code = nearest(x, middle)[0]
        total = np.zeros_like(middle)
        np.add.at(total, code, x)
        n = np.bincount(code, minlength=len(middle))
        middle[n > 0] = total[n > 0] / n[n > 0, None]
    return middle


def nearest(x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance to it."""
    code = np.argmin((middle * middle).sum(axis=1)[None, :] - 2 * (x @ middle.T), axis=1)
    return code, np.linalg.norm(x - middle[code], axis=1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[-1] + 1) // 2
    return x[..., :cut], x[..., cut:]


def cell_bounds(a: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a row of each cell may have with a, rounding included."""
    u, v = halves(a)
    middle = (index.left @ u)[index.cells[:, 0]] + (index.right @ v)[index.cells[:, 1]]
    around = np.linalg.norm(u) * index.radii[:, 0] + np.linalg.norm(v) * index.radii[:, 1]
    slack = 1e-9 * (np.abs(middle) + around) + 1e-6
    return middle - around - slack, middle + around + slack


def multi_sequence(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs (i, j) by falling p[i] + q[j], from a heap that holds one pair of each opened row."""
    by_p, by_q = np.argsort(-p, kind="stable"), np.argsort(-q, kind="stable")
    p, q = p[by_p].tolist(), q[by_q].tolist()
    heap = [(-(p[0] + q[0]), 0, 0)] if p and q else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield int(by_p[i]), int(by_q[j]), -bound
        if j + 1 < len(q):
            heapq.heappush(heap, (-(p[i] + q[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(p):
            heapq.heappush(heap, (-(p[i + 1] + q[0]), i + 1, 0))


class Block:
    """The rows of one block, by cell, with the greatest radius of each half-centre among them."""

    def __init__(self, rows: pd.DataFrame, left: np.ndarray, right: np.ndarray):
        rows = rows.sort_values(["c1", "c2", "vec_id", "rid"], ignore_index=True)
        self.rid, self.id, self.label = (rows[c].to_numpy() for c in ("rid", "vec_id", "label"))
        self.x = np.array(rows["q"].tolist(), np.int64)
        self.most = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64)
        codes = rows[["c1", "c2"]].to_numpy()
        new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
        self.span = {tuple(codes[a]): (a, b) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(codes)], strict=True)}
        self.codes, self.centres, self.radii = [], [], []
        for side, (centres, code, radius) in enumerate(((left, "c1", "r1"), (right, "c2", "r2"))):
            most = rows.groupby(code)[radius].max()
            self.codes.append(most.index.to_numpy())
            self.centres.append(centres[most.index.to_numpy()])
            self.radii.append(most.to_numpy())

    def scores(self, a: np.ndarray, real: np.ndarray, span: tuple[int, int]) -> np.ndarray:
        if self.most * int(np.abs(a).max(initial=0)) * len(a) < 1 << 53:
            return (self.real[span[0]:span[1]] @ real).astype(np.int64)
        return self.x[span[0]:span[1]] @ a

    def cells(self, a: np.ndarray) -> Iterator[tuple[tuple[int, int], float, float]]:
        """Spans of rows of cells by falling bound, with the least and the greatest score of them."""
        at = [c @ h for c, h in zip(self.centres, halves(a), strict=True)]
        around = [r * np.linalg.norm(h) for r, h in zip(self.radii, halves(a), strict=True)]
        for i, j, bound in multi_sequence(at[0] + around[0], at[1] + around[1]):
            span = self.span.get((self.codes[0][i], self.codes[1][j]))
            if span is not None:
                wide = 2 * (around[0][i] + around[1][j])
                slack = 1e-9 * (abs(bound) + wide) + 1e-6
                yield span, bound - wide - slack, bound + slack


def _top(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rids, ids, -scores))[:k]


def positives_of(block: Block, rid: int, label: int, a: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(score, vec_id, rid) of the first k other rows of the block with the label."""
    best = (np.zeros(0, np.int64),) * 3
    real = a.astype(np.float64)
    for span, _, upper in block.cells(real):
        if len(best[0]) == k and upper < best[0][-1]:
            break
        s, at = block.scores(a, real, span), slice(*span)
        fine = (block.label[at] == label) & (block.rid[at] != rid)
        if len(best[0]) == k:
            fine &= s >= best[0][-1]
        if fine.any():
            both = [np.concatenate([b, n[fine]]) for b, n in zip(best, (s, block.id[at], block.rid[at]), strict=True)]
            best = tuple(c[_top(*both, k)] for c in both)
    return list(zip(*(b.tolist() for b in best), strict=True))


def negatives_of(block: Block, label: int, a: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int, int]]]:
    """For each window (least, greatest score): (score, vec_id, rid) of the first k rows of other labels inside it."""
    best = [(np.zeros(0, np.int64),) * 3 for _ in windows]
    real, top = a.astype(np.float64), max(high for _, high in windows)
    for span, lower, upper in block.cells(real):
        need = [b[0][-1] if len(b[0]) == k else low for b, (low, _) in zip(best, windows, strict=True)]
        if upper < min(need):
            break
        if lower > top:
            continue
        s, at = block.scores(a, real, span), slice(*span)
        other = block.label[at] != label
        for w, (_, high) in enumerate(windows):
            fine = other & (s >= need[w]) & (s <= high)
            if fine.any():
                both = [np.concatenate([b, n[fine]]) for b, n in zip(best[w], (s, block.id[at], block.rid[at]), strict=True)]
                best[w] = tuple(c[_top(*both, k)] for c in both)
    return [list(zip(*(b.tolist() for b in found), strict=True)) for found in best]


def windows_of(scores: list[int], window: tuple[int, int] = WINDOW) -> list[tuple[int, int]]:
    """Least and greatest integer score of the negatives of positives with these scores."""
    return [(-(-window[0] * s // 100), window[1] * s // 100) for s in scores]


ROW = "rid long, vec_id long, label int, q array<int>"


def _indexed(rows: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                (c1, r1), (c2, r2) = (nearest(h, m) for h, m in zip(halves(x), (left, right), strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(r1), pa.array(r2)],
                                                 [*batch.schema.names, "c1", "c2", "r1", "r2"])
    return rows.mapInArrow(run, ROW + ", c1 int, c2 int, r1 double, r2 double")


def _index(rows: DataFrame, left: np.ndarray, right: np.ndarray, block: int) -> Index:
    """Cells and their blocks: at most centres x centres rows come to the driver."""
    cells = rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("c1", "c2").collect()
    first, pieces, at, held = [], [], 0, 0
    for cell in cells:
        if held and held + cell.n > block:
            at, held = at + 1, 0
        first.append(at)
        pieces.append(-(-cell.n // block))
        held += cell.n
        if pieces[-1] > 1:
            at, held = at + pieces[-1], 0
    return Index(left, right, np.array([(c.c1, c.c2) for c in cells]).reshape(-1, 2), np.array([(c.r1, c.r2) for c in cells]).reshape(-1, 2),
                 np.array([c.n for c in cells]), np.array(first), np.array(pieces))


def seed_cells(a: np.ndarray, index: Index, seed: int = SEED) -> np.ndarray:
    """The first cells by bound that hold `seed` rows together."""
    upper = cell_bounds(a, index)[1]
    order = np.argsort(-upper, kind="stable")
    return order[:int(np.searchsorted(np.cumsum(index.sizes[order]), seed)) + 1]


def blocks_of(cells: np.ndarray, index: Index) -> np.ndarray:
    many = index.pieces[cells]
    return np.unique(np.repeat(index.first[cells], many) + np.concatenate([np.arange(n) for n in many.tolist()] or [np.zeros(0, int)]))


def _routed(anchors: DataFrame, index: Index, wanted) -> DataFrame:
    """A row for every anchor and block that wanted(anchor, index) names."""
    held, names = anchors.sparkSession.sparkContext.broadcast(index), anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                blocks = wanted(row, held.value)
                if len(blocks):
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(blocks), np.int64)))
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array(blocks, pa.int32())], [*names, "block"])
    return anchors.mapInArrow(run, T.StructType([*anchors.schema, T.StructField("block", T.IntegerType())]))


def _seeds(row: dict, index: Index) -> np.ndarray:
    return blocks_of(seed_cells(np.array(row["q"], np.float64), index), index)


def _rest(row: dict, index: Index) -> np.ndarray:
    upper = cell_bounds(np.array(row["q"], np.float64), index)[1]
    return np.setdiff1d(blocks_of(np.flatnonzero(upper >= row["least"]), index), _seeds(row, index))


def _windows(row: dict, index: Index) -> np.ndarray:
    lower, upper = cell_bounds(np.array(row["q"], np.float64), index)
    wanted = np.zeros(len(lower), bool)
    for low, high in windows_of([p["score"] for p in row["positives"]]):
        wanted |= (low <= high) & (upper >= low) & (lower <= high)
    return blocks_of(np.flatnonzero(wanted), index)


def _searched(visits: DataFrame, blocks: DataFrame, index: Index, search, schema: str) -> DataFrame:
    """search(block, anchor) -> rows, for the anchors of each part that visit a block."""
    left, right = index.left, index.right

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(anchors) and len(rows):
            block = Block(rows, left, right)
            for anchor in anchors.itertuples(index=False):
                found += search(block, anchor)
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame(found, columns=names).astype(dict.fromkeys(names, "int64"))
    return visits.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInPandas(run, schema)


def _first(rows: DataFrame, by: list[str], score: str, ids: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc(score), *ids)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, is_anchor, centres: int, block: int, anchors_a_task: int) -> DataFrame:
    """The search among rows (rid, vec_id, label, q) of one number of dimensions."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "rid").limit(SAMPLE).select("q").toPandas()  # bounded
    left, right = (fit(h.astype(np.float64), centres) for h in halves(np.array(sample["q"].tolist(), np.float64)))
    rows = written(_indexed(rows.select("rid", "vec_id", "label", "q"), left, right), "neg-rows")
    index = _index(rows, left, right, block)
    where = rows.sparkSession.createDataFrame([(int(c[0]), int(c[1]), int(f), int(p)) for c, f, p in zip(index.cells, index.first, index.pieces, strict=True)],
                                              "c1 int, c2 int, first int, pieces int")  # a row a cell
    anchors = rows.where(is_anchor)
    parts = max(1, -(-anchors.count() // anchors_a_task))
    blocks = rows.join(F.broadcast(where), ["c1", "c2"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rid"), "pieces")).cast("int"))
    blocks = blocks.drop("first", "pieces").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    anchors = anchors.select("rid", "vec_id", "label", "q", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias("part"))

    def near(b: Block, a) -> list[tuple]:
        return [(a.rid, s, i, r) for s, i, r in positives_of(b, a.rid, a.label, np.asarray(a.q, np.int64), POSITIVES)]

    found = "rid long, score long, vec_id long, positive_rid long"
    best = ["rid"], "score", ["vec_id", "positive_rid"], POSITIVES
    one = written(_first(_searched(_routed(anchors, index, _seeds), blocks, index, near, found), *best), "neg-seeds")
    least = one.where(F.col("rank") == POSITIVES).select("rid", F.col("score").alias("least"))
    again = anchors.join(least, "rid", "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
    two = _searched(_routed(again, index, _rest), blocks, index, near, found)
    positives = written(_first(one.drop("rank").unionByName(two), *best), "neg-positives")

    def far(b: Block, a) -> list[tuple]:
        scores = [int(p["score"]) for p in a.positives]
        open_ = [(p, w) for p, w in zip(a.positives, windows_of(scores), strict=True) if w[0] <= w[1]]
        if not open_:
            return []
        lists = negatives_of(b, a.label, np.asarray(a.q, np.int64), [w for _, w in open_], NEGATIVES)
        return [(a.rid, a.vec_id, p["positive_rid"], p["vec_id"], p["score"], s, i, r) for (p, _), rows in zip(open_, lists, strict=True) for s, i, r in rows]

    held = positives.groupBy("rid").agg(F.collect_list(F.struct("score", "vec_id", "positive_rid")).alias("positives"))  # 5 at most
    visits = _routed(anchors.join(held, "rid"), index, _windows)
    result = _searched(visits, blocks, index, far, "rid long, anchor_id long, positive_rid long, positive_id long, positive_score long, negative_score long, negative_id long, negative_rid long")
    top = _first(result, ["rid", "positive_rid"], "negative_score", ["negative_id", "negative_rid"], NEGATIVES)
    return top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, is_anchor, relabel=None, centres: int = CENTRES, block: int = BLOCK, anchors_a_task: int = ANCHORS,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `is_anchor`
    is a condition on vec_id, `relabel` an expression of vec_id and label."""
    raw = F.transform(F.col(vec_col), lambda c: c.cast("double") * 256.0)
    fine = F.coalesce(F.size(vec_col) > 0, F.lit(False)) & ~F.coalesce(F.exists(raw, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(LIMIT))), F.lit(True))
    whole = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
                                       F.transform(raw, lambda c: F.floor(c).cast("int")).alias("q"))
    whole = whole.where("vec_id is not null and label is not null").withColumn("label", F.col("label") if relabel is None else relabel.cast("int"))
    rows = written(whole.withColumn("rid", F.monotonically_increasing_id()), "neg-integers")
    dims = sorted(r.d for r in rows.select(F.size("q").alias("d")).distinct().collect())  # one row a number of dimensions
    if not dims:
        return rows.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"),
                           F.col("vec_id").alias("positive_score"), F.col("vec_id").alias("negative_score"))
    mined = [_mined(rows if len(dims) == 1 else rows.where(F.size("q") == d), is_anchor, centres, block, anchors_a_task) for d in dims]
    return reduce(DataFrame.unionByName, mined)


SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op12_hard_negatives", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
