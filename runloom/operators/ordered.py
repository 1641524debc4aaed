"""Order-dependent scans without a single-task window.

Running sums, running minima and row positions over an order are computed in two levels: rows are cut into chunks by a
numeric order column, each chunk is summarised by a partial aggregate, the small chunk table gets its own exclusive
prefix, and the rows get a local window inside their chunk.

Over the whole table chunks are cut at quantiles of the order column (one aggregate, SPLITS of them at most), so they hold about
equally many rows however the values lie: sparse ids and one busy day are spread alike, and the chunk table has
SPLITS rows at most. Inside partitions the order column counts rows (a step number), and a chunk is a fixed range of it,
``width`` rows at most. No task ever sees an unbounded group, however skewed the partition keys are; only rows that are
equal in the order column stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles that one pass asks for, and their accuracy (relative rank error 1 / accuracy).
SPLITS, ACCURACY = 1_000, 20_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _combine(how: str, before: Column, local: Column) -> Column:
    if how in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    if how == "min":
        return F.least(before, local)  # least() skips NULLs
    if how == "max":
        return F.greatest(before, local)
    raise ValueError(how)


def split_bounds(df: DataFrame, order_col: str, width: int) -> list[int]:
    """Values of the order column that cut df into chunks of about `width` rows or more, 2 chunks at least and SPLITS at most."""
    shares = [i / SPLITS for i in range(1, SPLITS)]
    r = df.agg(F.count(order_col).alias("n"), F.percentile_approx(order_col, shares, ACCURACY).alias("q")).first()
    chunks = min(SPLITS, max(2, -(-r.n // width)))
    return sorted({r.q[SPLITS * i // chunks - 1] for i in range(1, chunks)}) if r.n else []


def split_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below the value, found in two steps over the square root of them each."""
    if not bounds:
        return F.lit(0)
    block = max(1, int(len(bounds) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b < value))
    coarse = below(F.array(*(F.lit(b) for b in bounds[block - 1::block])))
    return coarse * block + below(F.slice(F.array(*(F.lit(b) for b in bounds)), coarse * block + 1, F.lit(block)))


def prefix_agg(df: DataFrame, *, order_col: str, value: Column | str, how: str, out: str,
               partition_cols: Sequence[str] = (), tiebreak: Sequence[str] = (),
               inclusive: bool = True, width: int = 4096) -> DataFrame:
    """Add ``out`` = aggregate ``how`` of ``value`` over all earlier rows (and the row itself when
    ``inclusive``) in the order ``(order_col, *tiebreak)`` within ``partition_cols``.

    ``order_col`` must be numeric (a timestamp is turned into epoch microseconds by the caller). ``width`` is the least number
    of rows of a chunk; with ``partition_cols``, the range of ``order_col`` that makes one.
    """
    agg = _AGG[how]
    val = F.col(value) if isinstance(value, str) else value
    pcols = list(partition_cols)
    chunk = F.floor(F.col(order_col) / F.lit(width)) if pcols else split_of(F.col(order_col), split_bounds(df, order_col, width))
    d = df.withColumn("_pv", val).withColumn("_ch", chunk)
    tot = d.groupBy(*pcols, "_ch").agg(agg("_pv").alias("_tot"))
    wc = Window.partitionBy(*pcols).orderBy("_ch").rowsBetween(Window.unboundedPreceding, -1)
    if how == "count":
        before = F.sum("_tot").over(wc)
    else:
        before = agg("_tot").over(wc)
    tot = tot.select(*pcols, "_ch", before.alias("_before"))
    d = d.join(tot, [*pcols, "_ch"], "left")
    end = 0 if inclusive else -1
    wl = (Window.partitionBy(*pcols, "_ch").orderBy(order_col, *tiebreak)
          .rowsBetween(Window.unboundedPreceding, end))
    local = agg("_pv").over(wl)
    return d.withColumn(out, _combine(how, F.col("_before"), local)).drop("_pv", "_ch", "_tot", "_before")


def with_position(df: DataFrame, *, order_col: str, out: str = "pos", partition_cols: Sequence[str] = (),
                  width: int = 4096) -> DataFrame:
    """0-based row position in the order of a unique numeric column (per ``partition_cols``)."""
    d = prefix_agg(df, order_col=order_col, value=F.lit(1), how="count", out="_cnt",
                   partition_cols=partition_cols, inclusive=True, width=width)
    return d.withColumn(out, (F.col("_cnt") - 1).cast("long")).drop("_cnt")
