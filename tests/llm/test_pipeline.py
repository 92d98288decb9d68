from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quern.llm.common import table
from quern.llm.decontamination import decontaminate
from quern.llm.mixing import mix
from quern.llm.toxicity import score_toxicity

from .helpers import no_docs, odd_docs
from .test_near_copies import brute as groups


def key(rows, cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cols = docs.columns
    rows = docs.collect()

    out = P.toxicity(spark, docs, sf_dir)
    bad = {r["doc_id"] for r in score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    want = [r for r in rows if r["doc_id"] not in bad]
    assert bad and out.columns == cols and key(out.collect(), cols) == key(want, cols)

    docs, rows = spark.createDataFrame(want, docs.schema), want
    out = P.near_dedup(spark, docs, sf_dir)
    stay = {d for d, c in groups([(r["doc_id"], r["text"]) for r in rows]) if d == c}
    want = [r for r in rows if r["doc_id"] in stay]
    assert len(want) < len(rows) and out.columns == cols and key(out.collect(), cols) == key(want, cols)

    docs, rows = spark.createDataFrame(want, docs.schema), want
    out = P.decontamination(spark, docs, sf_dir)
    bad = {r["doc_id"] for r in decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
    want = [r for r in rows if r["doc_id"] not in bad]
    assert bad and out.columns == cols and key(out.collect(), cols) == key(want, cols)

    docs, rows = spark.createDataFrame(want, docs.schema), want
    out = P.mixing(spark, docs, sf_dir)
    uses = {r["doc_id"]: -(-r["taken"] // r["size"]) if r["size"] else 0 for r in mix(docs).collect()}
    want = [r for r in rows for _ in range(uses[r["doc_id"]])]
    assert max(uses.values()) == 2 and out.columns == cols and key(out.collect(), cols) == key(want, cols)

    out = P.sharding(spark, spark.createDataFrame(want, docs.schema), sf_dir).collect()
    assert key(out, cols) == key(want, cols)
    for s in range(P.SHARDS):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))

    whole = P.run(spark, sf_dir).collect()
    assert key(whole, [*cols, "shard"]) == key(out, [*cols, "shard"])


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_documents(spark, sf_dir, make):
    docs = make(spark)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert set(docs.columns) <= set(out.columns)
        if name != "mixing":
            assert len(rows) <= docs.count()
    kept = P.near_dedup(spark, docs, sf_dir).collect()
    assert len({r["text"] for r in kept}) == len({r["text"] or "" for r in kept}) <= len(kept)


def test_near_dedup_keeps_different_texts_under_one_id(spark, sf_dir):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(40))

    rows = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(4)), (None, text(4)), (5, text(4)), (7, text(7)), (6, text(7) + " more"), (8, text(8)), (8, text(8)), (9, None), (10, "")]
    for cast in (lambda i: i, lambda i: None if i is None else f"doc-{i:02d}"):
        kind = "long" if cast(1) == 1 else "string"
        docs = spark.createDataFrame([(cast(i), t, 0, 1) for i, t in rows], f"doc_id {kind}, text string, k1 int, row int")
        got = P.near_dedup(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((cast(i), t) for i, t in [(1, text(1)), (1, text(2)), (None, text(3)), (5, text(4)), (6, text(7) + " more"), (8, text(8)), (9, None)])


def test_clashing_columns(spark, sf_dir):
    names = ["__id", "__n", "__cell", "__at", "__start", "__copies", "__key", "__overlaps", "__may", "k1", "k2", "root", "row", "n", "size", "spot", "cell", "members", "shard", "slot", "fp", "node"]
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").limit(40)
    plain = {name: Counter(map(tuple, stage(spark, docs, sf_dir).select("doc_id", "text").collect())) for name, stage in P.STAGES}
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(100 + i))
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        last = name == "sharding"
        assert set(docs.columns) == set(out.columns) and (last or out.columns == docs.columns), name
        assert Counter((r["doc_id"], r["text"]) for r in rows) == plain[name], name
        assert all(r[n] == 100 + i for r in rows for i, n in enumerate(names) if not (last and n in ("shard", "slot"))), name
