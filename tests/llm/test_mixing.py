import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm.mixing import mix, route, targets

from .helpers import documents, no_docs, odd_docs


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("make", ["odd", "real", "none"])
def test_contract(spark, sf_dir, make):
    docs = {"odd": odd_docs, "none": no_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    rows = mix(docs, cells=16).collect()
    given = docs.select("doc_id", "text", "source").collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], words(r["text"])) for r in given)
    size = defaultdict(int)
    for r in given:
        size[r["source"]] += words(r["text"])
    goal = targets(size)
    source = {r["doc_id"]: r["source"] for r in given}
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            assert r["source_size"] == size[source[r["doc_id"]]] and r["target"] == pytest.approx(goal[source[r["doc_id"]]])
        taken[(r["source_size"], r["target"])] += r["taken"]
    for (s, t), n in taken.items():
        assert abs(n - t) <= 1 or [x for x in size.values()].count(s) > 1
    again = mix(docs, cells=16).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in rows)


def test_targets_reshare():
    t = targets({"b": 100, "a": 10, None: 40, "c": 50})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(300) and all(t[k] <= 2 * n for k, n in {"b": 100, None: 40, "c": 50}.items())
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0}


def brute_cost(patterns, quotas):
    """Least second uses at maximum flow, by trying all integer splits."""
    best = (-1, 0)

    def go(p, left, flow, cost):
        nonlocal best
        if p == len(patterns):
            best = max(best, (flow, -cost))
            return
        sources, size = patterns[p]

        def deal(k, room, left, used):
            if k == len(sources):
                go(p + 1, left, flow + used, cost + max(0, used - size))
                return
            q = sources[k]
            for x in range(min(room, left[q]) + 1):
                deal(k + 1, room - x, [*left[:q], left[q] - x, *left[q + 1 :]], used + x)

        deal(0, 2 * size, left, 0)

    go(0, list(quotas), 0, 0)
    return best


@pytest.mark.parametrize("patterns,quotas", [([((0,), 2), ((0, 1), 3), ((1,), 1)], [4, 5]), ([((0, 1), 4), ((1,), 2)], [3, 6]), ([((0,), 3), ((0, 1), 1), ((1,), 3)], [6, 2])])
def test_flow_is_least_cost(patterns, quotas):
    given = route(patterns, quotas)
    flow, cost = brute_cost(patterns, quotas)
    assert sum(given) == flow and sum(max(0, g - s) for g, (_, s) in zip(given, patterns)) == -cost


def test_overlapping_sources(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("of"))
    rows = mix(docs, members=F.col("of"), share=1.0, weights=(1, 1)).collect()
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - total) <= 2


@pytest.mark.parametrize("make", ["odd", "real", "many"])
def test_many_sources_need_no_flow(spark, sf_dir, monkeypatch, make):
    from quern.llm import mixing as M

    many = lambda s: s.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 17).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 700).cast("string"))).alias("source"))
    docs = {"odd": odd_docs, "many": many}.get(make, lambda s: documents(s, sf_dir))(spark)
    want = mix(docs, cells=16).collect()
    monkeypatch.setattr(M, "MAX_PATTERNS", 1)
    got = mix(docs, cells=16).collect()
    key = lambda rows: Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows)
    assert key(got) == key(want)
    with pytest.raises(ValueError, match="overlapping"):
        mix(docs, members=F.array(F.lit("a"), F.col("source")))
