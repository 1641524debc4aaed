"""Plan-shape regression tests: the scale properties the design relies on."""
import re

import pytest

from shared_values import SF_SMALL

import __spark_entry__ as E


def plan_of(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def nodes(plan: str, name: str) -> int:
    return len(re.findall(rf"^\(\d+\) {name}$", plan, flags=re.M))


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_config_arithmetic_is_one_narrow_projection(spark, q):
    for name in ("model_size", "flops_per_token", "window_sizes", "batch_math_check"):
        p = plan_of(spark, q[name](spark, SF_SMALL))
        assert nodes(p, "Exchange") == 0 and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in p


def test_first_write_wins_is_an_aggregate_not_a_window(spark, q):
    p = plan_of(spark, q["ingest_first_wins"](spark, SF_SMALL))
    assert nodes(p, "Window") == 0 and nodes(p, "Exchange") == 1
    assert "partial_min_by" in p


def test_encoder_runs_once_per_document(spark, q):
    p = plan_of(spark, q["bpb_by_lang"](spark, SF_SMALL))
    assert nodes(p, "ArrowEvalPython") == 1


def test_positions_read_only_the_key(spark, q):
    p = plan_of(spark, q["corpus_split"](spark, SF_SMALL))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", p)) == {"struct<doc_id:bigint>"}


def test_budget_moves_lengths_not_texts(spark, q):
    p = plan_of(spark, q["char_budget"](spark, SF_SMALL))
    for block in re.findall(r"^\(\d+\) Exchange\n(.*?)\n\n", p, flags=re.M | re.S):
        assert "text#" not in block.replace("capped_text_len", "")


def test_bucketed_registry_joins_without_shuffle(spark, q):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(spark, q["registry_bucketed_counts"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    assert "Exchange" not in p and nodes(p, "SortMergeJoin") == 2
