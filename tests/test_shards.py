import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quern.operators.quality import QualityError
from quern.sources.shards import ShardedTable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CLUSTER = """
import sys, duckdb
from pyspark.sql import SparkSession
d, shared = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for t in ("lineitem", "orders"):
    duckdb.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
for q in ("jdbc_scan", "jdbc_pushdown", "jdbc_promote"):
    got, want = sorted(map(tuple, e.queries()[q](spark, d).collect())), sorted(duckdb.sql(e.oracle_sql()[q]).fetchall())
    assert got == want and got, (q, len(got), len(want))
print("all same")
"""


def test_database_queries_on_a_cluster(sf_dir, tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", CLUSTER, sf_dir, str(tmp_path)], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "all same" in done.stdout, done.stderr[-3000:]


def test_files_are_bounded_and_types_come_back(spark, tmp_path):
    t = ShardedTable(spark, f"{tmp_path}/t")
    rows = spark.sql("SELECT id, cast(id AS int) AS i, if(id % 3 = 0, null, concat('é', id)) AS s, id / 7 AS x, timestamp_ntz'2020-01-02 03:04:05.123456' + make_interval(0, 0, 0, cast(id AS int)) AS at, timestamp'1960-01-02 03:04:05Z' AS then, date'1969-12-30' AS day FROM range(0, 250, 1, 2)")
    load = t.write(rows, 50)
    assert sorted(r["rows"] for r in spark.read.parquet(f"{t.path}/{load}/files").collect()) == [25, 25, 50, 50, 50, 50]
    kind = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    assert sorted(t.ask("SELECT * FROM rows", kind, load).collect()) == sorted(rows.collect())
    assert t.ask("SELECT id FROM rows WHERE s IS NULL AND id < 10", "id long", load).agg(F.sum("id")).first()[0] == 18
    with pytest.raises(ValueError, match="lacks"):
        t.write(spark.sql("SELECT array(1) AS a"))


def test_a_load_shows_whole_or_not_at_all(spark, tmp_path):
    t = ShardedTable(spark, f"{tmp_path}/t")
    assert t.load(spark.range(10), ["id"]) == 10
    for bad in (spark.range(5).union(spark.range(1)), spark.sql("SELECT if(id = 2, null, id) AS id FROM range(4)")):
        with pytest.raises(QualityError):
            t.load(bad, ["id"])
        assert t.count() == 10
    assert t.load(spark.range(0), ["id"]) == 0 and t.count() == 0
