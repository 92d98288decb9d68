from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quern import views as V
from quern.plans import marts as M
from quern.plans.daily import DailyStates


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def whole(events):
    return M.agg_clickstream_daily(events, M.int_clickstream_sessions(events))


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_increments_add_up(spark, sf_dir, tmp_path, parts):
    events, states = V.clicks(spark, sf_dir), DailyStates(spark, f"{tmp_path}/s")
    for i in range(parts):
        states.add(events.where(F.pmod(F.xxhash64("session_id", "event_timestamp", "item_id"), F.lit(parts)) == i), f"n{i}")
    assert states.increments() == [f"n{i}" for i in range(parts)] and rows(states.daily()) == rows(whole(events))
    some = [r[0] for r in events.select("event_date").distinct().orderBy("event_date").limit(3).collect()]
    assert rows(states.daily(some)) == rows(whole(events).where(F.col("event_date").isin(some)))


def test_odd_events(spark, tmp_path):
    at = lambda h: datetime(2026, 1, 1, h)
    data = [(1, at(1), date(2026, 1, 1), 5, "a"), (1, at(2), date(2026, 1, 1), None, None), (-7, at(3), date(2026, 1, 2), 2**40, "a"), (2**62, at(3), None, 0, "b"), (None, None, date(2026, 1, 3), None, None), (32768, at(4), date(2026, 1, 1), 32769, "")]
    events = spark.createDataFrame(data + data[:1], "session_id long, event_timestamp timestamp_ntz, event_date date, item_id long, category string")
    states = DailyStates(spark, f"{tmp_path}/s")
    states.add(events.limit(0), "none")
    assert states.daily().count() == 0
    states.add(events.where("session_id = 1"), "a")
    states.add(events.where("session_id is null or session_id <> 1"), "b")
    assert rows(states.daily()) == rows(whole(events))


def test_no_row_is_multiplied(spark, sf_dir, tmp_path):
    states = DailyStates(spark, f"{tmp_path}/s")
    states.add(V.clicks(spark, sf_dir), "a")
    plan = states.daily()._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "bitmap_or_agg" in plan
    assert "Expand" in whole(V.clicks(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
