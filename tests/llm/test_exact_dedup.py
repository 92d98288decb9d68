import hashlib
from collections import defaultdict

import pytest

from quern.llm.common import filter_of, may_have
from quern.llm.exact_dedup import compact, exact_dedup, flush_runs

from .helpers import documents, more_docs, no_docs, odd_docs


def brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        t = r["text"] or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"], i))
    out = []
    for s, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        for m in members:
            out.append((m[3], best[3], len(members), hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("make", ["odd", "real", "more", "none"])
def test_equals_brute_force(spark, sf_dir, digest_bytes, make):
    docs = {"odd": odd_docs, "none": no_docs, "more": more_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    got = exact_dedup(docs, digest_bytes=digest_bytes).collect()
    want = brute(docs.select("doc_id", "text").collect())
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r[3] for r in want})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("n", [0, 1, 1000, 60_000])
def test_filter_loses_no_key(spark, n):
    keys = spark.range(n).selectExpr("cast(id * 7 as string) key")
    known = filter_of(keys, "key", n)
    rows = may_have(spark.range(3 * n + 10).selectExpr("cast(id as string) key"), "key", known)
    assert rows.where("__may").join(keys, "key", "left_semi").count() == rows.join(keys, "key", "left_semi").count()
    assert rows.where("__may").join(keys, "key", "left_anti").count() <= 0.1 * rows.count()
    assert filter_of(keys, "key", n, most_bits=1).bitmaps is None


@pytest.mark.parametrize("options", [{"fan": 2}, {"most_bits": 1}, {"fan": 2, "most_bits": 1, "digest_bytes": 1}])
def test_levels_and_large_filters_give_the_same(spark, sf_dir, options):
    docs = documents(spark, sf_dir).repartition(9)
    a, b = (sorted(map(tuple, df.collect()), key=repr) for df in (exact_dedup(docs), exact_dedup(docs, **options)))
    assert [(*r[:3], r[4]) for r in a] == [(*r[:3], r[4]) for r in b]


def test_compaction_merges_levels(spark, sf_dir):
    runs = flush_runs(documents(spark, sf_dir).repartition(9))
    want = sorted(map(tuple, compact(runs, fan=100).collect()))
    assert sorted(map(tuple, compact(runs, fan=2).collect())) == want and sum(r[3] for r in want) == runs.count()


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(4000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute([{"doc_id": i, "text": t} for i, t in rows])


def test_main_path_has_no_python(spark, sf_dir):
    plan = exact_dedup(documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
