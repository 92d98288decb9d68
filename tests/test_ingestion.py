from datetime import date, datetime
from pathlib import Path

import pytest

from quern.functions.scalar import checked_identifier, request_id, safe_run_id, windows
from quern.operators.quality import QualityError
from quern.plans import pipelines as P
from quern.sources.files import Manifest, ingest_files, split_by_date
from quern.sources.weather_units import PLACES, checked_payload, fetched, ingest_forecasts, ingest_history
from quern.storage import SnapshotTable
from quern.streaming.ingest import ingest_new_files

T0 = datetime(2026, 8, 1)


class Crash(Exception):
    pass


def crash_at(step):
    def fail(s):
        if s == step:
            raise Crash

    return fail


def landing(tmp_path, days=2):
    for k in range(days):
        p = tmp_path / f"landing/event_date=2014-04-0{k + 1}"
        p.mkdir(parents=True, exist_ok=True)
        (p / "part-000.csv").write_text(f"1,2014-04-0{k + 1}T10:51:09.277Z,214536502,0\n2,2014-04-0{k + 1}T10:54:09.868Z,214536500,S\n{k + 3},2014-04-0{k + 1}T23:59:59.000Z,7,12\n")
    return f"{tmp_path}/landing"


def ingest(spark, tmp_path, **options):
    return ingest_files(spark, landing(tmp_path), f"{tmp_path}/bronze", f"{tmp_path}/manifest.json", now=lambda: T0, **options)


def test_files_once(spark, tmp_path):
    assert ingest(spark, tmp_path) == {"new": 2, "retried": 0, "skipped": 0}
    assert ingest(spark, tmp_path) == {"new": 0, "retried": 0, "skipped": 2}
    b = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/bronze")
    assert b.count() == 6 and len(b.columns) == 12 and b.select("_ingestion_id").distinct().count() == 2


@pytest.mark.parametrize("step", ["pending", "write", "processed"])
def test_files_after_a_crash(spark, tmp_path, step):
    with pytest.raises(Crash):
        ingest(spark, tmp_path, fail=crash_at(step))
    before = {k: e["ingestion_id"] for k, e in Manifest(spark, f"{tmp_path}/manifest.json").entries.items()}
    got = ingest(spark, tmp_path)
    assert got["new"] + got["retried"] == 2 and got["retried"] == len(before)
    after = Manifest(spark, f"{tmp_path}/manifest.json").entries
    assert all(after[k]["ingestion_id"] == i for k, i in before.items()) and {e["status"] for e in after.values()} == {"PROCESSED"}
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/bronze").count() == 6


def test_changed_file_is_refused(spark, tmp_path):
    ingest(spark, tmp_path)
    p = next(Path(f"{tmp_path}/landing").rglob("*.csv"))
    p.write_text("9,2014-04-01T10:51:09.277Z,1,0\n")
    with pytest.raises(ValueError, match="changed"):
        ingest_files(spark, f"{tmp_path}/landing", f"{tmp_path}/bronze", f"{tmp_path}/manifest.json")


def test_bad_line(spark, tmp_path):
    landing(tmp_path, 1)
    (tmp_path / "landing/event_date=2014-04-01/part-000.csv").write_text("1,2014-04-01T00:00:00Z,2\n")
    with pytest.raises(Exception, match="four fields"):
        ingest_files(spark, f"{tmp_path}/landing", f"{tmp_path}/bronze", f"{tmp_path}/m.json")


def test_clicks_end_to_end(spark, tmp_path):
    ingest(spark, tmp_path)
    go = lambda: P.click_events(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver")
    assert go() == 6 and go() == 0
    assert P.serve_clicks(spark, f"{tmp_path}/silver", f"{tmp_path}/staging") == "LOADED" and P.serve_clicks(spark, f"{tmp_path}/silver", f"{tmp_path}/staging") == "NO_OP"
    rows = SnapshotTable(spark, f"{tmp_path}/staging").read()
    assert rows.columns == ["session_id", "event_timestamp", "event_date", "item_id", "category"] and rows.count() == 6


def test_wrong_date_is_refused(spark, tmp_path):
    landing(tmp_path, 1)
    (tmp_path / "landing/event_date=2014-04-01/part-000.csv").write_text("1,2014-04-02T00:00:00Z,2,0\n")
    ingest_files(spark, f"{tmp_path}/landing", f"{tmp_path}/bronze", f"{tmp_path}/m.json")
    with pytest.raises(QualityError, match="wrong_event_date=1"):
        P.click_events(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver")


def test_split_and_stream(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.dat").write_text("1,2014-04-01T00:00:00Z,2,0\n2,2014-04-02T00:00:00Z,2,0\n")
    split_by_date(spark, f"{tmp_path}/raw", f"{tmp_path}/split")
    assert sorted(p.name for p in (tmp_path / "split").glob("event_date=*")) == ["event_date=2014-04-01", "event_date=2014-04-02"]
    run = lambda: ingest_new_files(spark, f"{tmp_path}/raw", "a long, b string, c long, d string", f"{tmp_path}/table", f"{tmp_path}/cp", fmt="csv")
    assert run() == 1 and run() == 0
    (tmp_path / "raw/b.dat").write_text("3,2014-04-03T00:00:00Z,2,0\n")
    assert run() == 1 and spark.read.parquet(f"{tmp_path}/table").count() == 3


def server(calls, humidity=50, shift=0.0):
    def fetch(params):
        calls.append(params)
        if "start_date" in params:
            a, b = (date.fromisoformat(params[k]) for k in ("start_date", "end_date"))
            days = [date.fromordinal(d) for d in range(a.toordinal(), b.toordinal() + 1)]
        else:
            days = [date(2026, 8, 1), date(2026, 8, 2)]
        times = [f"{d}T{h:02d}:00" for d in days for h in range(24)]
        n = len(times)
        hourly = {"time": times, "temperature_2m": [20.5 + shift] * n, "relative_humidity_2m": [humidity] * n, "precipitation": [0] * n, "wind_speed_10m": [1.5] * n, "weather_code": [3] * n}
        return 200, {"latitude": 1.0, "longitude": 2.0, "hourly_units": {"time": "iso8601"}, "hourly": hourly}

    return fetch


def test_forecast_end_to_end(spark, tmp_path):
    calls, root = [], f"{tmp_path}/w"
    assert ingest_forecasts(spark, root, T0, "r1", server(calls), PLACES[:2], now=lambda: T0) == {"committed": 2, "skipped": 0}
    assert ingest_forecasts(spark, root, T0, "r1", server(calls), PLACES[:3], now=lambda: T0) == {"committed": 1, "skipped": 2} and len(calls) == 3
    go = lambda: P.weather_forecast(spark, root, f"{tmp_path}/silver")
    assert go() == 3 and go() == 0
    rows = SnapshotTable(spark, f"{tmp_path}/silver").read()
    assert rows.count() == 144 and str(rows.agg({"forecast_time": "min"}).first()[0]) == "2026-07-31 17:00:00"
    with pytest.raises(Crash):
        ingest_forecasts(spark, root, T0, "r2", server(calls), PLACES[:1], fail=crash_at("_SUCCESS"))
    assert go() == 0  # without its marker a unit isn't there
    ingest_forecasts(spark, root, T0, "r3", server(calls, humidity=101), PLACES[:1])
    with pytest.raises(QualityError, match="humidity"):
        go()


def test_history_end_to_end(spark, tmp_path):
    calls, root = [], f"{tmp_path}/w"
    go = lambda: P.weather_history(spark, root, f"{tmp_path}/silver", f"{tmp_path}/control")
    assert ingest_history(spark, root, date(2026, 6, 1), date(2026, 6, 5), "r1", server(calls), PLACES[:1], days=3, now=lambda: T0) == {"committed": 2, "skipped": 0}
    assert go() == 2 and go() == 0
    assert ingest_history(spark, root, date(2026, 6, 1), date(2026, 6, 5), "r2", server(calls), PLACES[:1], days=3) == {"committed": 0, "skipped": 2}
    ingest_history(spark, root, date(2026, 6, 4), date(2026, 6, 6), "r3", server(calls, shift=1.0), PLACES[:1], days=3, now=lambda: datetime(2026, 8, 2))
    assert go() == 1
    rows = SnapshotTable(spark, f"{tmp_path}/silver").read()
    assert rows.count() == 144 and rows.where("temperature_2m = 21.5").count() == 72
    ingest_history(spark, root, date(2026, 7, 1), date(2026, 7, 2), "r4", server(calls), PLACES[:1])
    ingest_history(spark, root, date(2026, 7, 2), date(2026, 7, 3), "r5", server(calls, shift=2.0), PLACES[:1])
    with pytest.raises(QualityError, match="disagree"):
        go()


def test_fetching():
    answers = iter([(503, {}), (429, {}), (404, {})])
    with pytest.raises(RuntimeError, match="404"):
        fetched(lambda p: next(answers), {}, sleep=lambda s: None)
    good = server([])({})[1]
    assert checked_payload(good) is good
    for bad in (None, {}, good | {"hourly": good["hourly"] | {"time": []}}, good | {"hourly": {}}):
        with pytest.raises(ValueError):
            checked_payload(bad)


def test_small_functions():
    w = windows(date(2026, 5, 18), date(2026, 8, 15))
    assert len(w) == 3 and sum((b - a).days + 1 for a, b in w) == 90 and all((b[0] - a[1]).days == 1 for a, b in zip(w, w[1:]))
    assert request_id("a", "b") == request_id("a", "b") != request_id("a", "c")
    assert safe_run_id("manual__2026-01-01T00:00:00+00:00/x") == "manual__2026-01-01T00-00-00_00-00_x"
    assert checked_identifier("a_1") == "a_1"
    with pytest.raises(ValueError):
        checked_identifier("a-b")
    assert P.in_order({"b": (["a"], lambda d: d["a"] + 1), "a": ([], lambda d: 1)}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        P.in_order({"a": (["b"], None), "b": (["a"], None)})
