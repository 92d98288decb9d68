import uuid

import pytest
from pyspark.sql import functions as F

from quern import views as V
from quern.column_tests import CONTRACT
from quern.functions.scalar import request_id, request_id_of
from quern.operators.constraints import Tests, answers, compiled, names

ROWS = [(1, "a", 10), (2, "b", 10), (2, None, 11), (None, "c", None), (None, "c", 99), (5, "a", 10)]


def tables(spark):
    return {"t": spark.createDataFrame(ROWS, "k int, w string, p long"), "parent": spark.createDataFrame([(10,), (10,), (11,), (None,)], "id long")}


def got(df):
    return {r["check_name"]: r["failures"] for r in df.collect()}


ALL = Tests(("k", "w", "p"), (("k",), ("w",), ("k", "w")), (("p", "parent", "id"),))
WANT = {"not_null_t_k": 2, "not_null_t_w": 1, "not_null_t_p": 1, "unique_t_k": 1, "unique_t_w": 2, "unique_t_k_w": 0, "relationship_t_p": 1}


@pytest.mark.parametrize("t", [ALL, Tests(ALL.not_null), Tests((), ALL.keys), Tests((), (), ALL.parents), Tests(ALL.not_null, (), ALL.parents), Tests(ALL.not_null, (("w",),))])
def test_each_test_is_answered_once(spark, t):
    want = {n: WANT[n] for n in names("t", t)}
    assert got(answers(tables(spark), {"t": t})) == want and answers(tables(spark), {"t": t}).count() == len(want)


def test_empty_tables(spark):
    empty = {n: df.limit(0) for n, df in tables(spark).items()}
    assert got(answers(empty, {"t": ALL})) == dict.fromkeys(WANT, 0)


def test_passes(spark, tmp_path):
    """Nulls cost no pass beside a key, and no exchange by themselves; foreign keys share one."""
    for n, df in tables(spark).items():
        df.write.parquet(f"{tmp_path}/{n}")
    t = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("t", "parent")}
    plan = lambda tests: [p._jdf.queryExecution().executedPlan().toString() for p in compiled(t, {"t": tests})]
    one = plan(Tests(ALL.not_null, (("k",),)))
    assert len(one) == 1 and one[0].count("FileScan") == 1 and one[0].count("hashpartitioning") == 1
    nulls = plan(Tests(ALL.not_null))
    assert len(nulls) == 1 and nulls[0].count("FileScan") == 1 and "hashpartitioning" not in nulls[0]
    two = plan(Tests(ALL.not_null, (), (("p", "parent", "id"), ("k", "parent", "id"))))
    assert len(two) == 1 and two[0].count("FileScan") == 3
    assert len(plan(ALL)) == 4


def test_refused():
    for bad in (lambda: Tests(("a", "a")), lambda: Tests((), (("a",), ("a",))), lambda: Tests((), ("ab",)), lambda: Tests((), ((),))):
        with pytest.raises(ValueError):
            bad()


def test_the_contract_is_whole():
    assert sum(len(t.not_null) for t in CONTRACT.values()) == 120 and sum(len(t.keys) for t in CONTRACT.values()) == 21


def test_request_ids(spark):
    rows = [("weather", "a"), ("é:😀", ""), ("", ""), ("x", None)] + [(str(i), str(i * i)) for i in range(200)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", request_id_of(F.col("a"), F.col("b")).alias("id")).collect():
        assert r["id"] == (None if r["b"] is None else request_id(r["a"], r["b"])) and (r["id"] is None or uuid.UUID(r["id"]).version == 5)


def test_lines_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    """With more lines than the session's partitions are to hold there are more partitions, and the same rows."""
    plain, lines = sorted(map(tuple, V.order_lines(spark, sf_dir).collect()), key=repr), V.read(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(V, "TASK_LINES", lines // 20)
    assert V.order_lines(spark, sf_dir).rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, V.order_lines(spark, sf_dir).collect()), key=repr) == plain
