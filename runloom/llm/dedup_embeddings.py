"""Embedding near-duplicates (operator 4): int8 tile products with rigorous error bounds.

Every distinct vector x is scaled to length 1 and quantised to s * q with integer q in [-127, 127]; e = |x - s * q| is
kept. For two vectors |x.y - s_x s_y q_x.q_y| <= e_y |s_x q_x| + e_x, so a pair whose integer product plus that bound
stays below the threshold cannot link; only the other pairs are computed again in double precision from the original
components. Integer products of a tile of two blocks are one matrix product (exact in single precision: at most
127 * 127 * dimensions must stay below 2**24, else double is used).

Equal vectors are one row with a count before the products. Blocks hold BLOCK vectors at most; each tile is a task of
its own that reads two blocks, whatever groups they belong to. A tile returns, for every vector with a link, its number of links
and the smallest vector that it reaches inside the tile: rows grow with vectors and tiles, not with links.

Exact links have no cheaper exact plan for vectors in general position: comparisons grow with the square of the
number of distinct vectors, in tiles that any number of executors share. See the README for figures.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different dimensions don't link; equal vectors of several ids, and repeated rows, link with one another; a null id is
kept as a row of its own vector; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.catalog import query
from runloom.llm.common import components, forest, read, written

THRESHOLD = 0.9
BLOCK = 4_096
#: Rows of a tile multiplied at a time.
ROWS = 1_024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x -> integer rows, scale, length of the scaled integer row, length of what quantisation lost (rounded up)."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1) + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) with cosine >= threshold; of a block with itself those with i < j."""
    (qx, sx, lx, ex), (qy, sy, ly, ey) = quantise(x), quantise(y)
    exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
    right, nx, ny = qy.astype(exact).T, np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(x), ROWS):
        b = min(a + ROWS, len(x))
        first = a if same else 0
        product = qx[a:b].astype(exact) @ right[:, first:]
        # s_x s_y q.q >= threshold - e_y |s_x q_x| - e_x, the loosest e_y of the block first
        least = (threshold - ey[first:].max(initial=0) * lx[a:b] - ex[a:b] - 1e-9) / sx[a:b]
        i, j = np.nonzero(product * sy[None, first:].astype(np.float32) >= least[:, None].astype(np.float32) * np.float32(1 - 1e-5) - np.float32(1e-5))
        bound = sx[a + i] * sy[first + j] * product[i, j].astype(np.float64) + ey[first + j] * lx[a + i] + ex[a + i]
        i, j = a + i[bound >= threshold - 1e-9], first + j[bound >= threshold - 1e-9]
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 1 << 16):
            u, v = i[c:c + (1 << 16)], j[c:c + (1 << 16)]
            cosine = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v])
            found.append((u[cosine >= threshold], v[cosine >= threshold]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _tile(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        x = group[group["block"] == low].sort_values("vec_id")
        y = x if low == high else group[group["block"] == high].sort_values("vec_id")
        if not len(x) or not len(y):
            return pd.DataFrame({"vec_id": [], "links": [], "least": []}).astype("int64")
        i, j = tile_links(np.array(x["v"].tolist(), np.float64), np.array(y["v"].tolist(), np.float64), threshold, low == high)
        shift = 0 if low == high else len(x)
        ids = x["vec_id"].to_numpy() if low == high else np.concatenate([x["vec_id"].to_numpy(), y["vec_id"].to_numpy()])
        copies = x["copies"].to_numpy() if low == high else np.concatenate([x["copies"].to_numpy(), y["copies"].to_numpy()])
        j = j + shift
        links = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        label = forest(len(ids), i, j)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        hit = links > 0
        return pd.DataFrame({"vec_id": ids[hit], "links": links[hit].astype(np.int64), "least": least[label][hit]})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda c: c.cast("double") + F.lit(0.0)).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda c: c != 0.0)
    rows = written(rows.select("vec_id", F.when(fine, F.col("v")).alias("v")), "emb-rows")
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("dim", F.size("v")), "emb-distinct")
    blocks = {r.dim: max(1, -(-r.n // block)) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a dimension
    sized = distinct.join(F.broadcast(spark.createDataFrame(list(blocks.items()) or [(0, 1)], "dim int, blocks int")), "dim")
    mine = sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = mine.withColumn("other", others).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    tiles = written(spread.select("dim", "low", "high", "block", "vec_id", "copies", "v").groupBy("dim", "low", "high")
                    .applyInPandas(_tile(threshold), "vec_id long, links long, least long"), "emb-tiles")
    linked = tiles.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comps = components(tiles.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    per = distinct.select("vec_id", "copies", "v").join(linked, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    good = rows.where("v is not null").join(per, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
