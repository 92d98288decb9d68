import random

import numpy as np
import pytest
import xxhash

from quern.llm.simhash import Forest, fingerprint, hamming_links, simhash_near_dups, trie_join

from .helpers import documents, no_docs, odd_docs


def slow_fingerprint(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, budget=3):
    fps = sorted({f for _, f in rows})
    f = Forest(len(fps))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= budget:
                f.join(i, j)
    root = {x: f.root(i) for i, x in enumerate(fps)}
    least = {}
    for d, x in rows:
        if d is not None:
            least[root[x]] = min(least.get(root[x], d), d)
    return sorted(((d, f"{x:016x}", least.get(root[x])) for d, x in rows), key=repr)


@pytest.mark.parametrize("make", ["odd", "real", "none"])
def test_equals_brute_force(spark, sf_dir, make):
    docs = {"odd": odd_docs, "none": no_docs}.get(make, lambda s: documents(s, sf_dir))(spark)
    rows = [(r["doc_id"], slow_fingerprint(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_near_dups(docs).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("group", [4096, 128])
def test_links_connect_what_is_near(spark, group):
    from quern.llm.simhash import components

    rnd = random.Random(5)
    fps = set()
    for _ in range(2):
        centre = rnd.getrandbits(64)
        for _ in range(250):
            x = centre
            for _ in range(rnd.randrange(7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    roots = {r["node"]: r["root"] for r in components(hamming_links(spark.createDataFrame(signed, "fp long"), 3, group)).collect()}
    f, order = Forest(len(fps)), sorted(fps)
    for i, a in enumerate(order):
        for j in range(i):
            if (a ^ order[j]).bit_count() <= 3:
                f.join(i, j)
    want, got = {}, {}
    for i, x in enumerate(order):
        s = x - (1 << 64) if x >> 63 else x
        want.setdefault(f.root(i), set()).add(s)
        got.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_trie_finds_all_pairs():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 8, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[i % 8] ^ (np.uint64(1) << rnd.integers(0, 64, 1).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 1).astype(np.uint64)) for i in range(400)]))
    got = {(int(x), int(y)) for a, b in trie_join(fps, np.array([0]), np.array([len(fps)]), 3) for x, y in zip(a, b)}
    want = {(j, i) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert got == want


def test_fingerprint():
    for t in ["", "a", "a b", "A b c", "one two three four", "one two three one two three"]:
        assert fingerprint(t.encode()) == slow_fingerprint(t)
