import math
import random
import time
import zlib
from collections import Counter

import pytest

from quern.llm import toxicity as T
from quern.llm.toxicity import Lexicon, chosen, different, entries, fold, folded, least_shingles, learn, score_toxicity

from .helpers import documents, no_docs, odd_docs


def test_fold():
    assert fold("Idiot") == fold("1d10t") == fold("іdіоt") == fold("ｉｄｉｏｔ") == fold("id!ot") == "idiot"
    assert fold("the$$$") == fold("the###") == "the" and fold("2024") == "" and fold("stuuuupid") == "stuupid" and fold("Straße") == "straße" and fold("é") == "é"


def test_exceptions_and_length():
    lex = Lexicon({" trash ": 3.0, " lowe": 2.0})
    assert lex.features("put it into the trash can")[0] == 0 and lex.features("you are trash")[0] > 0 and lex.features("loweichen da")[0] > 0 and lex.features("flowers")[0] == 0
    assert lex.features("you are tr4sh " + "word " * 1000)[1] < lex.features("you are trash")[1]
    assert 0 <= lex.score("") <= 1


@pytest.mark.parametrize("make", ["odd", "real", "none"])
def test_rows(spark, sf_dir, make):
    docs = {"odd": odd_docs, "none": no_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_labels_are_not_used(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (score_toxicity(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_learns_words_and_starts(spark):
    ends = ["".join(p) for p in __import__("itertools").product("abcdef", repeat=2)]
    rows = [(f"some plain words {i} {i * 7} and {i * 3} " + (f"a zork of {i * 5}" if i % 2 else f"all is {i * 11} well"), i % 2) for i in range(160)] + [(f"bla {i} blu {i * 3} grumm{e} bli {i * 5}", 1) for i, e in enumerate(ends)] + [(f"bla {i} blu {i * 3} bli {i * 7}", 0) for i in range(60)]
    rows += [(f"they sell a zork lamp here {i} words {i * 13}", 0) for i in range(8)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    lex = learn(df, prior=())
    assert lex.score("a zork") > 0.5 and lex.score("x grummxyz y") > 0.5 and lex.score("some plain words") < 0.3
    assert " zork " in lex.weights and any(e.startswith(" grum") for e in lex.weights) and not any(e.startswith(" bla") for e in lex.weights)
    assert "zork lamp" in lex.exceptions and lex.score("zork lamp") < 0.3 < lex.score("zork lamp zork")
    assert "zork of" in learn(df, exceptions=("zork of",)).exceptions
    assert learn(spark.createDataFrame([], "text string, toxic int")).score("you idiot") > 0.3


def slow_features(lex, text):
    """Every word against every entry, and every phrase at every place."""
    words = folded(text).split()
    spared = set()
    for p in lex.exceptions:
        ps = p.split()
        for i in range(len(words) - len(ps) + 1):
            if words[i : i + len(ps)] == ps:
                spared.update((i + j, len(ps) - j) for j in range(len(ps)))
    best, total = {}, 0.0
    for i, w in enumerate(words):
        fits = [x for e, x in lex.weights.items() if f" {w} ".startswith(e) and i not in {k for k, _ in spared}]
        if fits:
            best[w] = max(fits)
            total += max(fits)
    return math.log1p(sum(best.values())), math.log1p(100 * total / (20 + len(words) + 1)) if best else 0.0, math.log1p(len(best))


def test_features_equal_naive_matcher():
    rnd = random.Random(4)
    stems = ["zork", "grum", "bla", "foo", "lamp", "and"]
    for _ in range(200):
        lex = Lexicon({f" {rnd.choice(stems)}{rnd.choice(['', 'x'])}{rnd.choice(['', ' '])}": rnd.random() * 5 for _ in range(4)}, ("zork lamp", "and foo bla"))
        text = " ".join(rnd.choice(stems) + rnd.choice(["", "", "x", "xy"]) for _ in range(rnd.randint(0, 40)))
        assert lex.features(text) == pytest.approx(slow_features(lex, text)), (lex.weights, text)


def test_entry_counts_equal_naive_version(spark):
    rnd = random.Random(8)
    rows = [(" ".join(rnd.choice(["aaaa", "aaaab", "aaaabcd", "bbb", "cccccccccc"]) + rnd.choice(["", "q", "w"]) for _ in range(rnd.randint(1, 30))), rnd.randint(0, 1)) for _ in range(60)]
    want = {}
    for t, x in rows:
        for e, n in entries(t)[0].items():
            c = want.setdefault(e, [0, 0, 0])
            c[1 - x] += n
            c[2] += x
    want = {e: tuple(c) for e, c in want.items() if c[2] >= T.SUPPORT}
    got = {r["entry"]: (r["toxic"], r["clean"], r["support"]) for r in T.entry_counts(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert {e: c for e, c in got.items() if e and c[2] >= T.SUPPORT} == want
    assert got[""][:2] == tuple(sum(len(set(t.split())) for t, x in rows if x == y) for y in (1, 0))


def test_chance_and_nested_entries():
    noise = {f" w{i} ": (3, 20, 3) for i in range(500)}
    counts = {"": (3000, 30000, 500), " grum": (40, 2, 12), " grumm": (38, 2, 12), " gru": (41, 60, 13), " zork ": (20, 0, 15), " zork": (20, 0, 15), " rare ": (3, 0, 3)} | noise
    assert set(chosen(counts, ())) == {" grum", " zork "}
    assert set(chosen(counts, ("rare", "unseen", "w1"))) == {" grum", " zork ", " rare ", " unseen "}


def test_long_texts_take_linear_time():
    lex = Lexicon({" trash ": 3.0}, ("trash can",))
    start = time.time()
    assert lex.features("trash can " * 200_000) == (0.0, 0.0, 0.0) and lex.features("trash can " * 200_000 + "trash")[2] > 0
    assert time.time() - start < 20


def test_near_copies_in_training_count_once():
    words = [f"w{i}" for i in range(300)]
    shared = " ".join(f"licence{i}" for i in range(40))
    texts = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(0, 300, 20)] + [" ".join(f"own{k}word{i}" for i in range(60)) + shared for k in range(10)]
    assert len(different([{"sketch": least_shingles(t)} for t in texts])) == 11


def held_out_figures(spark, d, train=None):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    n = Counter((k, r["predicted"], r["toxic"]) for r in rows for k in (r["lang"], "all"))
    return {k: (n[k, 1, 1], n[k, 1, 0], n[k, 0, 1]) for k in {k for k, _, _ in n}}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    for lang, (tp, fp, fn) in held_out_figures(spark, f"/root/testdata/{sf}").items():
        # a few labels of each language are noise, so one miss of few is allowed
        assert fn <= max(1, 0.1 * (tp + fn)) and fp <= max(1 + (lang == "all"), 0.1 * (tp + fp)), (sf, lang, tp, fp, fn)


def test_entries_come_from_labels_not_from_the_prior(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (score_toxicity(docs, labels, prior=p) for p in (T.PRIOR, ()))
    same = a.join(b.select("doc_id", b.predicted.alias("other")), "doc_id").where("predicted = other").count()
    assert same >= 0.995 * docs.count()
