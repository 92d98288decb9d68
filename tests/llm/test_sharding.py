import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm.sharding import rendezvous, shard_documents

from .helpers import documents, no_docs, odd_docs


@pytest.mark.parametrize("make", ["odd", "real", "none"])
def test_contract(spark, sf_dir, make):
    docs = {"odd": odd_docs, "none": no_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    rows = shard_documents(docs, cells=8).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_the_doc_id_decides(spark, sf_dir):
    docs = documents(spark, sf_dir)
    a = {r["doc_id"]: r["shard"] for r in shard_documents(docs).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard_documents(docs.selectExpr("doc_id", "'other' AS text").where("doc_id % 2 = 0")).collect()}
    assert b and all(a[k] == s for k, s in b.items())


def test_weights(spark):
    from pyspark.sql import functions as F

    n = Counter(r[0] for r in spark.range(20_000).select(rendezvous(F.col("id").cast("string"), [1.0, 2.0, 0.0, 5.0])).collect())
    assert n[2] == 0 and abs(n[0] / 2500 - 1) < 0.1 and abs(n[1] / 5000 - 1) < 0.1 and abs(n[3] / 12_500 - 1) < 0.1


def test_equal_weights_move_few(spark):
    from pyspark.sql import functions as F

    key = F.col("id").cast("string")
    rows = spark.range(20_000).select(rendezvous(key, [1.0] * 24).alias("a"), rendezvous(key, [1.0] * 25).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 24 for r in rows)
    assert 0.5 < sum(r["a"] != r["b"] for r in rows) / 800 < 1.5
    assert max(Counter(r["a"] for r in rows).values()) < 1.2 * 20_000 / 24


def test_no_weights():
    with pytest.raises(ValueError):
        rendezvous(None, [])
