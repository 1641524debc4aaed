"""Display formatting as column expressions.

Fixed values: the missing-value mark is an em dash "—"; the dirty marks are "*" (table) and
" (dirty)" (detail); timestamps show as "MMM dd yyyy HH:mm" in an English locale; run ids are
"exp_%Y%m%d_%H%M%S" in UTC; memory is shown in GB with one decimal; an unscored run is logged as
0.000000.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

DASH = "—"


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def val_bpb_text(v: Column) -> Column:
    """six decimals; NULL / NaN is a dash."""
    return F.when(_missing(v), F.lit(DASH)).otherwise(F.format_string("%.6f", v))


def round_half_up_int(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def duration_text(s: Column) -> Column:
    """F2: under a minute '12.3s'; otherwise 'Mm Ss' where the seconds are rounded after the
    split, so 119.6 becomes '1m 60s' (kept on purpose)."""
    mins = F.floor(s / 60).cast("long")
    rest = s % F.lit(60.0)
    return (F.when(_missing(s), F.lit(DASH))
            .when(s < 60, F.concat(F.format_string("%.1f", s), F.lit("s")))
            .otherwise(F.concat(mins.cast("string"), F.lit("m "), round_half_up_int(rest).cast("string"), F.lit("s"))))


def _fixed(units: Column, decimals: int) -> Column:
    """Integer count of 10^-decimals units rendered as a fixed-point string."""
    scale = 10 ** decimals
    whole = (units / scale).cast("long")
    frac = F.lpad(F.pmod(units, F.lit(scale)).cast("string"), decimals, "0")
    return F.concat(whole.cast("string"), F.lit("."), frac)


def _rounded_units(n: Column, unit: int, decimals: int) -> Column:
    """n / unit in units of 10^-decimals, rounded as the double n / unit rounds: only where the decimal value is a tie can
    the double lie below it, and then the units round down. Both are compared as exact integers."""
    step = unit // 10 ** decimals
    units = ((n * 2 + step) / (2 * step)).cast("long")
    quotient = n.cast("double") / F.lit(float(unit))
    binary = ((quotient - F.floor(quotient)) * F.lit(float(1 << 52))).cast("long").cast("decimal(19,0)") * F.lit(unit).cast("decimal(10,0)")
    exact = F.pmod(n, F.lit(unit)).cast("decimal(10,0)") * F.lit(1 << 52).cast("decimal(19,0)")
    tie = F.pmod(n * 2, F.lit(2 * step)) == step
    return units - F.when(tie & (binary < exact), 1).otherwise(0)


def params_text(n: Column) -> Column:
    """'x.xxM' from a million, 'x.xK' from a thousand, else plain; rounded as the binary quotient."""
    n = n.cast("long")
    return (F.when(n.isNull(), F.lit(DASH))
            .when(n >= 1_000_000, F.concat(_fixed(_rounded_units(n, 1_000_000, 2), 2), F.lit("M")))
            .when(n >= 1_000, F.concat(_fixed(_rounded_units(n, 1_000, 1), 1), F.lit("K")))
            .otherwise(n.cast("string")))


def short_commit(c: Column) -> Column:
    """first 7 characters; empty or NULL is a dash."""
    return F.when(c.isNull() | (c == ""), F.lit(DASH)).otherwise(F.substring(c, 1, 7))


def timestamp_text(s: Column) -> Column:
    """text timestamp shown as 'MMM dd yyyy HH:mm'; text that does not parse passes through."""
    t = F.try_to_timestamp(s)
    return (F.when(s.isNull() | (s == ""), F.lit(DASH))
            .when(t.isNull(), s)
            .otherwise(F.date_format(t, "MMM dd yyyy HH:mm")))


def commit_with_dirty(c: Column, dirty: Column, detail: bool = False) -> Column:
    """'*' in the table, ' (dirty)' on the detail page."""
    mark = " (dirty)" if detail else "*"
    return F.concat(short_commit(c), F.when(dirty, F.lit(mark)).otherwise(F.lit("")))


def _or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(DASH))


def config_label(depth: Column, seq: Column, vocab: Column) -> Column:
    """'d4 / L256 / v1024'."""
    return F.concat(F.lit("d"), _or_dash(depth), F.lit(" / L"), _or_dash(seq), F.lit(" / v"), _or_dash(vocab))


def architecture_label(depth: Column, seq: Column, vocab: Column, window: Column) -> Column:
    """F8: 'depth=4 seq=256 vocab=1024 window=L'."""
    return F.concat(F.lit("depth="), _or_dash(depth), F.lit(" seq="), _or_dash(seq), F.lit(" vocab="),
                    _or_dash(vocab), F.lit(" window="), _or_dash(window))


def status_class(status: Column) -> Column:
    """ok is good; crash and fail are bad; anything else is neutral."""
    return (F.when(status == "ok", F.lit("good"))
            .when(status.isin("crash", "fail"), F.lit("bad"))
            .otherwise(F.lit("neutral")))


def run_id_from_time(ts: Column) -> Column:
    """'exp_%Y%m%d_%H%M%S' (session time zone is UTC)."""
    return F.date_format(ts, "'exp_'yyyyMMdd_HHmmss")


def time_from_run_id(run_id: Column) -> Column:
    """F10 inverse: NULL for ids that do not carry a time."""
    body = F.regexp_extract(run_id, r"^exp_(\d{8}_\d{6})$", 1)
    return F.when(body != "", F.try_to_timestamp(body, F.lit("yyyyMMdd_HHmmss")))


def checkpoint_to_show(child_path: Column, run_path: Column) -> Column:
    """the child checkpoint's path, else the run's own non-empty path."""
    return F.coalesce(child_path, F.when(run_path != "", run_path))


def memory_gb(peak_vram_mb: Column) -> Column:
    """GB with one decimal."""
    return F.round(peak_vram_mb / F.lit(1024.0), 1)


def log_val_bpb(v: Column) -> Column:
    """the results log writes 0.000000 for an unscored run (log only)."""
    return F.format_string("%.6f", F.coalesce(F.when(~_missing(v), v), F.lit(0.0)))


@pandas_udf(StringType())
def _pretty_json(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), indent=2, ensure_ascii=False)
        except ValueError:
            return x
    return s.map(one)


def pretty_json(c: Column) -> Column:
    """two-space indented JSON (display only; an Arrow-batched helper)."""
    return _pretty_json(c)
