"""Results must not depend on the session time zone (wall-clock timestamps are TIMESTAMP_NTZ)."""
import pytest

from shared_values import SF_SMALL

import __spark_entry__ as E

TIME_SENSITIVE = ["keep_discard", "training_progress", "run_stop_step", "run_times", "latest_run", "run_id_roundtrip"]


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_same_result_in_another_time_zone(spark, name):
    q = E.queries()[name]
    utc = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other
