import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm.packing import pack, placed, plan, units_of

from .helpers import documents, more_docs, no_docs, odd_docs

MODEL = public_tokenizers.path("word_bpe_49k.json")


def unrolled(counts, capacity):
    """Bins of a plan as lists of (offset, length); all pieces are there once."""
    runs, used = plan(counts, capacity)
    bins, seen = defaultdict(list), Counter()
    for n, first, many, b, each, offset in runs:
        for i in range(many):
            seen[n, first + i] += 1
            bins[b + i // each].append((offset + i % each * n, n))
    assert seen == Counter((n, i) for n, c in counts.items() for i in range(c))
    assert set(bins) == set(range(used))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in members) <= 2
    return bins


def most_pairs(lengths, capacity):
    """Fewest bins of pieces above a third, by matching in the plainest way: the longest with the longest that fits."""
    left, bins = sorted(lengths), 0
    while left:
        n, bins = left.pop(), bins + 1
        if fits := [i for i, m in enumerate(left) if n + m <= capacity]:
            left.pop(fits[-1])
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 30, 64, 100])
    counts = {n: rnd.choice([1, 2, 3, 7, 40]) for n in rnd.sample(range(1, capacity + 1), rnd.randint(1, capacity // 2))}
    bins = unrolled(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    large = [n for n, c in counts.items() for _ in range(c) if 3 * n > capacity]
    assert sum(any(3 * n > capacity for _, n in b) for b in bins.values()) == most_pairs(large, capacity)
    assert len(bins) <= max(most_pairs(large, capacity), -(-total // capacity)) * 11 / 9 + 1


def test_plan_is_bounded():
    """As many documents as there are on a cluster cost no more than a few."""
    runs, used = plan({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(runs) < 92_000 and used < 1.01 * sum(n * (10**9 + n) for n in range(1, 2049)) / 2048
    assert plan({}, 8) == ([], 0)
    with pytest.raises(ValueError):
        plan({9: 1}, 8)


def brute_pieces(docs, capacity):
    t, out = Tokenizer.from_file(MODEL), []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(r["doc_id"], k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    return Counter(out)


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("make", ["odd", "real", "more", "none"])
@pytest.mark.parametrize("capacity", [2048, 16])
def test_equals_brute_force(spark, sf_dir, make, capacity):
    docs = {"odd": odd_docs, "none": no_docs, "more": more_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    rows = pack(docs, MODEL, capacity).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute_pieces(docs, capacity)
    used = check_sequences(rows, capacity)
    assert used <= 1.02 * sum(r["length"] for r in rows) / capacity + 1 + (capacity == 16) * used / 50


def test_one_length_is_dealt_out(spark):
    """A third and more of all pieces have one length; they are numbered by ranges, so none of the tasks gets them all."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 700).otherwise(F.col("id") % 2048 + 1).cast("int").alias("length"), F.col("id").alias("tag"))
    got = placed(rows, 2048).collect()
    assert len(got) == 30_000
    check_sequences(got, 2048)


def test_units_equal_the_library(spark):
    units, rnd = units_of(open(MODEL, encoding="utf-8").read()), random.Random(5)
    letters = "abcdeorstnilABC'.,-129éñüßªº²İ́ſ🙂ǅΣς中 \u0085\x00\x01\x1c<|>endoftxt_"
    some = ["".join(rnd.choices(letters, k=rnd.randint(0, 20))) for _ in range(20_000)] + ["<|endoftext|>", "a<|startoftext|>b", "I'll", "x" * 5000, ""]
    ids, n = units.encode(some)
    want = [units.library.encode(u, add_special_tokens=False).ids for u in some]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert units.in_order


def test_white_space_parts_units(spark):
    texts = ["a\tb\r\nc  d e\x1cf\x0bg", " \n ", "don't<|endoftext|> stop", "İstanbul ΣΑΣ é ́x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pack(docs, MODEL, 4).collect()) == brute_pieces(docs, 4)
