"""Validation and integrity checks (V1, V2, V5, V6, V7, J4) as DataFrame plans.

Every check produces a *violations table* instead of raising, so a bad row never stops a batch:
good rows flow on, bad rows go to quarantine with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.schemas import JSON_FIELDS, LENGTH_LIMITS, NOT_NULL, RESULT_SCHEMA, STATUS_OK


def _accepts(v, name: str, kind: str):
    """Whether the value of a payload's field can be read as ``kind`` without loss; an absent field or a JSON null can.
    Numbers may come as text; text may not come as a number; a whole number may be written with a zero fraction."""
    path = f"$.{name}"
    given = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.try_variant_get(v, path, "double")
    if name in JSON_FIELDS:  # an object, or one as text, as our own sink writes it
        inner = F.schema_of_variant(F.try_parse_json(F.try_variant_get(v, path, "string")))
        fits = given.startswith("OBJECT") | ((given == "STRING") & F.coalesce(inner.startswith("OBJECT"), F.lit(False)))
    elif kind == "string":
        fits = given == "STRING"
    elif kind == "boolean":
        fits = F.when(given.isin("BOOLEAN", "STRING"), F.try_variant_get(v, path, "boolean").isNotNull()).otherwise(number.isin(0.0, 1.0))
    elif kind == "double":
        fits = number.isNotNull()
    else:
        fits = (number == F.floor(number)) & F.try_variant_get(v, path, kind).isNotNull()
    return F.when(given.isNull() | (given == "VOID"), True).otherwise(F.coalesce(fits, F.lit(False)))


def _payload_fields(v) -> dict:
    return {f.name: F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()) for f in RESULT_SCHEMA}


def checked(df: DataFrame, text_col: str, more: dict[str, str] | None = None) -> DataFrame:
    """df with `_p`: the payload's fields (`got`) and reason; ``more``: columns of further fields by name and type, null where a
    payload has no such value. The text is parsed once a row, and what fields and
    checks have in common is read once, in a projection: a generator shares nothing, but its output is no alias that a filter
    on it could be pushed through, with a parse for each of its fields."""
    v, c = F.col("_v"), F.col("_c")
    got = F.struct(*(x.alias(n) for n, x in _payload_fields(v).items()))
    fits = F.struct(*(_accepts(v, f.name, f.dataType.simpleString()).alias(f.name) for f in RESULT_SCHEMA))
    others = [F.try_variant_get(v, f"$.{n}", kind).alias(n) for n, kind in (more or {}).items()]
    read = df.withColumn("_v", F.try_parse_json(F.col(text_col)))
    read = read.select(*df.columns, *others, F.struct(got.alias("got"), fits.alias("fits"), v.isNull().alias("none")).alias("_c"))
    kept = read.columns[:-1]
    reason = F.when(c["none"], F.lit("not_json"))
    for name in NOT_NULL:
        reason = reason.when(c["got"][name].isNull(), F.lit(f"missing_{name}"))
    for f in RESULT_SCHEMA:
        reason = reason.when(~c["fits"][f.name], F.lit(f"bad_{f.name}"))
    return read.select(*kept, F.explode(F.array("_c")).alias("_c")).select(*kept, F.struct(c["got"].alias("got"), reason.alias("reason")).alias("_p"))


def validate_payload_text(df: DataFrame, text_col: str) -> DataFrame:
    """V1 + V2 + P13 over raw JSON text: adds ``experiment_id``, ``status``, ``reason`` (NULL when the payload is accepted
    for ingest: an object with id and status whose fields all have their types) and ``accepted`` (status ok with a numeric
    val_bpb). The reason of a payload with several faults is the first: not_json, missing_<field>, bad_<field> in the
    order of the result's columns."""
    p = F.col("_p")
    ok = p["reason"].isNull() & (p["got"]["status"] == STATUS_OK) & p["got"]["val_bpb"].isNotNull()
    return checked(df, text_col).select(*df.columns, p["got"]["experiment_id"].alias("experiment_id"), p["got"]["status"].alias("status"),
                                         p["reason"].alias("reason"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def split_valid(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Good payloads parsed into the result schema, and the quarantine (with ``reason``)."""
    return split_checked(checked(df, text_col), text_col)


def split_checked(d: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """:func:`split_valid` of a frame that :func:`checked` made (and the caller may have persisted)."""
    own = [c for c in d.columns if c != "_p"]
    good = d.where("_p.reason is null").select("_p.got.*", *(c for c in own if c != text_col))
    return good, d.where("_p.reason is not null").select(*own, "_p.got.experiment_id", "_p.got.status", "_p.reason")


def key_violations(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """V5: duplicate (run, metric, step) with a non-NULL step, and duplicate run keys."""
    m = (metrics.where(F.col("step").isNotNull())
         .groupBy("experiment_uuid", "metric_name", "step").agg(F.count(F.lit(1)).alias("n"))
         .where(F.col("n") > 1)
         .select(F.lit("metric_key").alias("kind"),
                 F.concat_ws("|", "experiment_uuid", "metric_name", F.col("step").cast("string")).alias("key"), "n"))
    r = (runs.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
         .select(F.lit("run_key").alias("kind"), F.col("experiment_id").alias("key"), "n"))
    return m.unionByName(r)


def column_violations(df: DataFrame, key: str, limits: dict[str, int] | None = None,
                      not_null: tuple[str, ...] = NOT_NULL) -> DataFrame:
    """V6: one pass over the table; every failed rule becomes a row (key, column, violation, length)."""
    limits = LENGTH_LIMITS if limits is None else limits
    rules = []
    for c, n in limits.items():
        if c in df.columns:
            rules.append(F.when(F.length(c) > n, F.struct(F.lit(c).alias("column_name"), F.lit("too_long").alias("violation"),
                                                          F.length(c).cast("long").alias("length"))))
    for c in not_null:
        if c in df.columns:
            rules.append(F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column_name"), F.lit("null").alias("violation"),
                                                            F.lit(None).cast("long").alias("length"))))
    return (df.select(key, F.explode(F.array(*rules)).alias("v")).where(F.col("v").isNotNull())
            .select(key, "v.column_name", "v.violation", "v.length"))


def orphans(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Children whose run is not registered, and runs whose parent is unknown."""
    ids = runs.select(F.col("id").alias("experiment_uuid"))
    out = (metrics.join(ids, "experiment_uuid", "left_anti")
           .select(F.lit("metric").alias("kind"), F.col("id").alias("child_key"), F.col("experiment_uuid").alias("missing_ref")))
    if checkpoints is not None:
        out = out.unionByName(checkpoints.join(ids, "experiment_uuid", "left_anti").select(
            F.lit("checkpoint").alias("kind"), F.col("id").alias("child_key"), F.col("experiment_uuid").alias("missing_ref")))
    known = runs.select(F.col("experiment_id").alias("parent_experiment_id"))
    par = (runs.where(F.col("parent_experiment_id").isNotNull())
           .join(known, "parent_experiment_id", "left_anti")
           .select(F.lit("parent").alias("kind"), F.col("experiment_id").alias("child_key"),
                   F.col("parent_experiment_id").alias("missing_ref")))
    return out.unionByName(par)


def corpus_size_guard(n_rows: int, train_start: int) -> None:
    """V7: a corpus must have more rows than the train split start."""
    if n_rows <= train_start:
        raise ValueError(f"expected more than {train_start} rows, got {n_rows}")
