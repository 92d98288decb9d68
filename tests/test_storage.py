from datetime import datetime, timedelta

import pytest

from quern.operators.quality import QualityError
from quern.operators.versions import changes, merge_newer
from quern.storage import Files, SnapshotTable, load_staging

T0 = datetime(2026, 1, 1)
SCHEMA = "k long, v string, updated_at timestamp_ntz, _ingested_at timestamp_ntz"


def df(spark, *rows):
    return spark.createDataFrame([(k, v, None if u is None else T0 + timedelta(days=u), None if i is None else T0 + timedelta(days=i)) for k, v, u, i in rows], SCHEMA)


def values(frame):
    return {r["k"]: r["v"] for r in frame.collect()}


def test_overwrite_append_merge(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t")
    assert not t.exists() and t.version() == 0
    t.overwrite(df(spark, (1, "a", 1, 1), (2, "b", 1, 1)))
    t.append(df(spark, (3, "c", 1, 1)))
    assert values(t.read()) == {1: "a", 2: "b", 3: "c"} and t.version() == 2
    assert t.merge(df(spark, (1, "old", 0, 9), (2, "new", 2, 1), (3, "same", 1, 1), (4, "d", None, 1)), ["k"]) == 2
    assert values(t.read()) == {1: "a", 2: "new", 3: "c", 4: "d"}
    v = t.version()
    assert t.merge(df(spark, (2, "new", 2, 1)), ["k"]) == 0 and t.version() == v
    with pytest.raises(QualityError):
        t.merge(df(spark, (9, "x", 1, 1), (9, "y", 1, 1)), ["k"])
    t.insert_new(df(spark, (1, "z", 9, 9), (5, "e", 1, 1), (5, "e", 1, 1)), ["k"])
    assert values(t.read()) == {1: "a", 2: "new", 3: "c", 4: "d", 5: "e"}
    assert t.vacuum() > 0 and values(t.read())[5] == "e"
    t.overwrite(t.read().where("k = 1"))
    assert values(t.read()) == {1: "a"}


def test_failed_check_leaves_the_table(spark, tmp_path):
    src, target = df(spark, (1, "a", 1, 1)), SnapshotTable(spark, f"{tmp_path}/s")
    assert load_staging(src, target, ["k"]) == "LOADED" and load_staging(src, target, ["k"], skip_same=True) == "NO_OP"
    for bad in (df(spark, (1, "x", 1, 1), (1, "y", 1, 1)), df(spark, (None, "x", 1, 1))):
        with pytest.raises(QualityError):
            load_staging(bad, target, ["k"])
    assert values(target.read()) == {1: "a"} and len([n for n in Files(spark).names(target.path) if n.startswith("data-")]) == 1


def test_newer(spark):
    old = df(spark, (1, "o", 1, 1), (2, "o", 1, 1), (3, "o", None, 1), (4, "o", 1, None), (5, "o", 2, 1), (6, "o", None, None))
    new = df(spark, (1, "n", 2, 0), (2, "n", 1, 2), (3, "n", 1, 0), (4, "n", 1, 0), (5, "n", 1, 9), (6, "n", None, None), (7, "n", None, None))
    assert sorted(r["k"] for r in changes(new, old, ["k"]).collect()) == [1, 2, 3, 4, 7]
    assert values(merge_newer(old, new, ["k"])) == {1: "n", 2: "n", 3: "n", 4: "n", 5: "o", 6: "o", 7: "n"}


def test_small_files(spark, tmp_path):
    f = Files(spark)
    p = f"{tmp_path}/d/x.json"
    f.write(p, "{}")
    f.write(p, "ä")
    assert f.read(p) == "ä" and f.names(f"{tmp_path}/d") == ["x.json"] or f.read(p) == "ä"
    assert f.names(f"{tmp_path}/none") == [] and f.walk(f"{tmp_path}/none", "x") == []
    f.delete(p)
    assert not f.exists(p)
