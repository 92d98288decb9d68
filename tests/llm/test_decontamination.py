import itertools
import math
import random
import time

import numpy as np
import pytest

from quern.llm.decontamination import LEAST_HITS, MASKS, MATCH, MIN_WORDS, SeedIndex, clean_documents, decontaminate, plain, raw_words, stretch

from .helpers import documents, no_docs, odd_docs


def brute(item, text):
    """Longest overlap over all shifts and stretches."""
    a, b = ([w for w in map(plain, raw_words(t)) if w] for t in (item, text))
    best = 0
    for shift in range(-len(a) + 1, len(b)):
        for i in range(len(a)):
            for j in range(i + min(MIN_WORDS, len(a)), len(a) + 1):
                if 0 <= i + shift and j + shift <= len(b) and j - i > best and sum(a[k] == b[k + shift] for k in range(i, j)) >= MATCH * (j - i):
                    best = j - i
    return best


def test_overlaps_equal_brute_force():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [" ".join(rnd.choices(words, k=n)) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 13, 20, 30)]
    index = SeedIndex(list(enumerate(items)))
    for i, item in enumerate(items):
        w = item.split()
        for share in (0.0, 0.1, 0.2):
            for _ in range(6):
                some = [x if rnd.random() >= share else "zzz" for x in w]
                text = " ".join(rnd.choices(words, k=15) + some + rnd.choices(words, k=15))
                assert index.overlaps(text).get(i, 0) == brute(item, text), (item, text)


def test_even_substitutions_are_found():
    item = " ".join(f"w{i}" for i in range(40))
    index = SeedIndex([(0, item)])
    for first in range(5):
        text = " ".join("x" if i % 5 == first else f"W{i}," for i in range(40))
        assert index.overlaps(f"lead {text} tail").get(0, 0) >= 36


def test_stretch():
    item = np.arange(1, 21)
    assert stretch(item, item, 0) == 20 and stretch(item, item[5:], -5) == 15 and stretch(item, item[:11], 0) == 0
    assert stretch(item, np.zeros(20, int), 0) == 0


@pytest.mark.parametrize("make", ["odd", "real", "none"])
def test_documents(spark, sf_dir, make):
    docs = {"odd": odd_docs, "none": no_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontaminate(docs, bench).collect()
    assert len(rows) == docs.count()
    if make == "real":
        items = {r["item_id"]: r["text"] for r in bench.collect()}
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        norm = lambda t: f" {' '.join(w for w in map(plain, t.split()) if w)} "
        for r in rows:
            whole = {i for i, t in items.items() if norm(t) in norm(texts[r["doc_id"]])}
            assert whole <= set(r["items"]) and r["contaminated"] == bool(r["items"])


def test_empty_benchmark(spark, sf_dir):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, " ... ")], "item_id long, text string")
    assert decontaminate(documents(spark, sf_dir), bench).where("contaminated").count() == 0
    assert decontaminate(documents(spark, sf_dir), bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_blocks_cover_all_items(spark, sf_dir, monkeypatch):
    from quern.llm import decontamination as d

    bench, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir)
    whole = decontaminate(docs, bench).orderBy("doc_id").collect()
    monkeypatch.setattr(d, "BLOCK_WORDS", 400)
    assert decontaminate(docs, bench).orderBy("doc_id").collect() == whole


@pytest.mark.parametrize("at", range(5))
def test_short_item_with_a_substitution_and_no_other_known_word(at):
    words = [f"w{i}" for i in range(5)]
    item, text = " ".join(words), " ".join(["x", *words[:at], "zzz", *words[at + 1 :], "y"])
    assert SeedIndex([(0, item)]).overlaps(text) == {0: brute(item, text)} != {0: 0}


def test_least_hits():
    def hits(same):
        return sum(all(same[p + k] for k, c in enumerate(m) if c == "1") for m in MASKS for p in range(len(same) - len(m) + 1))

    def least(n):
        return min(hits([i not in bad for i in range(n)]) for bad in itertools.combinations(range(n), n - math.ceil(MATCH * n - 1e-9)))

    assert {n: least(n) for n in range(5, 12)} == {n: h for n, h in LEAST_HITS.items() if n < 12}
    assert min(least(n) for n in range(12, 20)) == LEAST_HITS[12]


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_real_documents_equal_brute_force(spark, sf_dir, monkeypatch, block_words):
    """Whole operator on real rows, with short and unspaced items, against all shifts and stretches."""
    from quern.llm import decontamination as d

    monkeypatch.setattr(d, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(d, "LINES", 500)
    rnd = random.Random(1)
    texts = [" ".join((r["text"] or "").split()[:60]) for r in documents(spark, sf_dir).limit(60).collect()]
    items = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(8).collect())]
    items += [(100, "中文没有空格的句子在这里"), (101, "two words"), (102, "zork"), (103, "Ja, nein! vielleicht doch")]
    for i, (_, t) in enumerate(items[:8]):
        w = t.split()
        texts[i] += " " + " ".join(x if rnd.random() > 0.15 else "zzz" for x in w)
    texts += ["一些 中文没有空格的句子在这里。 more", "just two words.", "a Zork!", "ja nein vielleicht doch", "ja nein vielleicht"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: {i: n for i, t in items if (n := brute(t, x))} for k, x in enumerate(texts)}
    got = decontaminate(docs, bench).collect()
    assert {r["doc_id"]: (r["items"], r["overlap_words"]) for r in got} == {k: (sorted(v), max(v.values(), default=0)) for k, v in want.items()}
    assert sum(map(bool, want.values())) >= 10
    assert sorted(r["doc_id"] for r in clean_documents(docs, bench).collect()) == [k for k, v in want.items() if not v]


def test_shared_phrases_are_pruned():
    phrase = "choose the right answer from"
    items = [(i, f"{phrase} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(4000)]
    index = SeedIndex(items)
    start = time.time()
    assert index.overlaps(f"{phrase} y " * 530) == {}
    assert index.overlaps(f"{phrase} y " * 100 + items[7][1]) == {7: 25}
    assert time.time() - start < 20


@pytest.mark.parametrize("block_words", [5, 10**6])
def test_columns_of_any_name_stay(spark, monkeypatch, block_words):
    """Many blocks as one: names that the work itself uses are taken by the input."""
    from quern.llm import decontamination as d

    monkeypatch.setattr(d, "BLOCK_WORDS", block_words)
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve")], "item_id long, text string")
    rows = [(1, "x one two three four five six y", 7, 8, 9, b"1", "k"), (2, "nothing of it here at all", 1, 2, 3, b"2", "k"), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __may long, __bucket long, __at int, __bits binary, __key string")
    got = d.clean_documents(docs, bench)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows[1:])
