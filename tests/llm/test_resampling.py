import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm.queries import ORACLE_SQL, QUERIES
from quern.llm.resampling import buckets_of, importance_resample, words_of

from ..parity import compare
from .helpers import documents, more_docs, no_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2, buckets=10_000):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=2, buckets=10_000, percent=25, least=20, seed=7):
    rows = [(d, *features(t, longest, buckets)) for d, t in docs]
    s = Counter(b for _, _, f in rows for b in f)
    t = Counter(b for x in target for b in features(x, longest, buckets)[1])
    ns, nt = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in range(buckets)]
    out = []
    for d, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    first = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(first[: percent * len(first) // 100]):
        r[4] = i + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("make", ["odd", "real", "more", "none"])
@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50, "percent": 100, "least_words": 1, "seed": 1}, {"percent": 0}])
def test_equals_brute_force(spark, sf_dir, make, options):
    docs = {"odd": odd_docs, "none": no_docs, "more": more_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = Counter(map(tuple, importance_resample(docs, target, **options).collect()))
    names = {"least_words": "least"}
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()], **{names.get(k, k): v for k, v in options.items()})


def test_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, QUERIES["op12_resampling"], ORACLE_SQL["op12_resampling"]) == ""


def test_ties_and_one_score(spark):
    """All rows have one text, so many have one score; ranks go on by id and have no gap."""
    docs = spark.range(3000).select((F.col("id") % 1500).alias("doc_id"), F.lit("ein Wort " * 15).alias("text"))
    target = spark.createDataFrame([(None,), ("",)], "text string")
    rows = importance_resample(docs, target, percent=50).collect()
    assert Counter(map(tuple, rows)) == brute([(i % 1500, "ein Wort " * 15) for i in range(3000)], [None, ""], percent=50)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1501))


def test_odd_words(spark):
    texts = ["ÀB ÄÖ ſK İI x1y", "a\x00b\x7fc", "日本 語😀", "A-B_C", "É" * 40]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", buckets_of(words_of(F.col("text"))).alias("b")).collect()
    assert {r["i"]: r["b"] for r in got} == {i: features(t)[1] for i, t in enumerate(texts)}


def test_scores_are_not_exploded(spark, sf_dir):
    """The only rows made of features are those that are counted."""
    df = importance_resample(documents(spark, sf_dir), documents(spark, sf_dir))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan
