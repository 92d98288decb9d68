import random

import numpy as np
import pytest

import corpus_pipeline as P
from quern.llm import near_copies as N
from quern.llm.common import made
from quern.llm.near_copies import near_copies
from quern.llm.simhash import Forest

from .helpers import documents, no_docs, odd_docs


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.encode().split() if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    f = Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                f.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[f.root(i)] = min(least.get(f.root(i), d), d)
    return sorted(((d, least.get(f.root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(spark):
    rnd, rows = random.Random(11), []
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    for _ in range(150):
        words = list(base)
        for _ in range(rnd.randrange(9)):
            words[rnd.randrange(200)] = f"v{rnd.randrange(5000)}"
        rows.append((len(rows), " ".join(words)))
    for _ in range(60):  # one passage, different texts
        rows.append((len(rows), " ".join([f"u{rnd.randrange(5000)}" for _ in range(60)] + base[:40])))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("make", ["edited", "odd", "real", "none"])
def test_equals_brute_force(spark, sf_dir, make):
    docs = {"edited": edited, "odd": odd_docs, "none": no_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_copies(docs).collect()), key=repr)
    assert got == want


def test_pipeline_stage_drops_near_copies(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stay = {d for d, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if d == c}
    assert {r["doc_id"] for r in P.near_dedup(spark, docs, sf_dir).collect()} == stay


def test_bitmaps_lose_no_similar_pair(spark):
    rnd, rows, want = random.Random(5), [], []
    for i in range(300):
        n, other = rnd.choice([1, 2, 9, 60, 300, 2000]), rnd.random() * 0.3
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = {x if rnd.random() > other else rnd.getrandbits(64) for x in a}
        marks = [N.marks_of(np.array(sorted(x), "<u8")).tolist() for x in (a, b)]
        rows.append((i, len(a), marks[0], len(b), marks[1]))
        if 5 * len(a & b) >= 4 * len(a | b):
            want.append(i)
    got = spark.createDataFrame(rows, "i int, sizea long, marksa array<long>, sizeb long, marksb array<long>").where(N.may_be_similar())
    assert set(want) <= (got := {r["i"] for r in got.collect()}) and len(want) <= len(got) < 300


def test_sets_are_made_for_near_pairs_alone(spark, monkeypatch):
    """Texts that share a passage meet in cells; their whole sets don't move."""
    rnd, counts, plain = random.Random(3), [], N.written
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([f"u{rnd.randrange(5000)}" for _ in range(60)]) + " " + passage) for i in range(60)] + [(i, f"near {passage} {'x' * (i - 99)}") for i in (100, 101)]

    def written(df, name, **options):
        out = plain(df, name, **options)
        counts.append(out.count() if name == "sets" else 0)
        return out

    monkeypatch.setattr(N, "written", written)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(i, 100) for i, _ in rows} and 2 <= sum(counts) <= 4


def test_pipeline_stage_keeps_no_tables_but_those_of_its_result(spark, sf_dir):
    before = made()
    P.near_dedup(spark, documents(spark, sf_dir), sf_dir)
    assert made() - before <= 2
