"""SimHash near-duplicates: fingerprints, a binary-trie self-join within a Hamming budget, connected components.

Fingerprints are combined first, so that copies count once. Two fingerprints that differ in at most `budget` bits agree
in one of `budget + 1` blocks of bits; the distinct fingerprints are dealt by (block, value). Groups above `GROUP` are
dealt anew by blocks of their remaining bits, again and again, which loses no pair. In each group a binary trie is
joined with itself: pairs of nodes go down together, differing bits are counted, and a pair of nodes is left as soon as
the count exceeds the budget. A task hands on only links between fingerprints that it has not connected yet, so a
group gives fewer links than it has members. Components come from alternating star contractions over written tables.

Defined results: a null text is the empty text; texts without words have fingerprint zero; a null id is never a
component id unless all ids of the component are null; rows that repeat get the same result; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

SEED = 42
#: Fingerprints of a group that one trie holds; larger groups are dealt anew by more bits.
GROUP = 4096
#: Pairs of trie nodes that are compared leaf by leaf.
LEAVES = 64


def shingle_hashes(text: bytes, k: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, k: int = 3) -> int:
    """A bit is 1 if set in over half the hashes of the k-word shingles; unsigned."""
    return bits_of(np.array(shingle_hashes(text, k), dtype="<u8"))


def bits_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode(), k) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(text_or_empty(text_col)).alias("fp"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def expand(a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions of node pairs that are small."""
    n = a_n * b_n
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return a_lo[which] + k // b_n[which], b_lo[which] + k % b_n[which]


def trie_join(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a < b) of fingerprints of a group that differ in at most `budget` bits.

    fps: unsigned, sorted within each group [start, end) and distinct. A trie node is a range of the sorted array; all
    groups go down together, level by level. Node pairs are worked off in batches, which bounds the memory.
    """
    keep = ends - starts > 1
    work = [(0, starts[keep], ends[keep], starts[keep], ends[keep], np.zeros(int(keep.sum()), np.int64))]
    while work:
        depth, al, ah, bl, bh, diff = work.pop()
        if len(al) > 200_000:
            h = len(al) // 2
            work += [(depth, al[:h], ah[:h], bl[:h], bh[:h], diff[:h]), (depth, al[h:], ah[h:], bl[h:], bh[h:], diff[h:])]
            continue
        small = ((ah - al) * (bh - bl) <= LEAVES) | (depth == 64)
        if small.any():
            a, b = expand(al[small], (ah - al)[small], bl[small], (bh - bl)[small])
            a, b = a[a < b], b[a < b]
            hit = popcount(fps[a] ^ fps[b]) <= budget
            if hit.any():
                yield a[hit], b[hit]
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        bit = np.uint64(63 - depth)
        mids = [split(fps, lo, hi, bit) for lo, hi in ((al, ah), (bl, bh))]
        same = al == bl
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                lo1, hi1 = (al, mids[0]) if x == 0 else (mids[0], ah)
                lo2, hi2 = (bl, mids[1]) if y == 0 else (mids[1], bh)
                d = diff + (x != y)
                ok = (lo1 < hi1) & (lo2 < hi2) & (d <= budget) & ~(same & (x > y))
                parts.append((lo1[ok], hi1[ok], lo2[ok], hi2[ok], d[ok]))
        merged = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(merged[0]):
            work.append((depth + 1, *merged))


def split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each sorted range whose higher bits agree, the first position where the bit is 1."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_] = (fps[mid[open_]] >> bit) & np.uint64(1) == 1
        lo, hi = np.where(open_ & ~one, mid + 1, lo), np.where(open_ & one, mid, hi)


class Forest:
    """Union-find over positions; of each pair says whether it connects anything new."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def group_links(frames: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Links (a, b) within the groups of a task whose rows are sorted by (block, value)."""
    rest: pd.DataFrame | None = None

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        group = np.zeros(len(pdf), np.int64)
        for c in ("block", "value"):
            v = pdf[c].to_numpy()
            group[1:] |= v[1:] != v[:-1]
        group = np.cumsum(group)
        order = np.lexsort((fps, group))
        fps, group = fps[order], group[order]
        edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        seen, out = Forest(len(fps)), []
        for a, b in trie_join(fps, edge[:-1], edge[1:], budget):
            out += [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if seen.join(x, y)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]})

    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = (pdf["block"] == pdf["block"].iloc[-1]) & (pdf["value"] == pdf["value"].iloc[-1]) if len(pdf) else None
        if last is None:
            continue
        rest = pdf[last]
        if not last.all():
            yield links(pdf[~last])
    if rest is not None and len(rest):
        yield links(rest)


def dealt(cells: DataFrame, budget: int) -> DataFrame:
    """Each fingerprint of a cell goes to budget + 1 cells by the blocks of the cell's free bits.

    cells: (block, value, used, fp), `used` being the mask of the bits on which the cell's fingerprints agree already.
    The free bits are dealt out by turns among the blocks, so that the blocks' sizes differ by one at most.
    """

    @F.pandas_udf("array<struct<block:long,value:long,used:long>>")
    def deal(block: pd.Series, value: pd.Series, used: pd.Series, fp: pd.Series) -> pd.Series:
        masks: dict[int, list[int]] = {}
        out = []
        for bl, va, us, f in zip(block.tolist(), value.tolist(), used.tolist(), fp.tolist(), strict=True):
            if us not in masks:
                free = [i for i in range(63, -1, -1) if not us & 0xFFFFFFFFFFFFFFFF >> i & 1]
                masks[us] = [sum(1 << i for i in free[k :: budget + 1]) for k in range(min(len(free), budget + 1))]
            row = []
            for k, m in enumerate(masks[us]):
                now = us & 0xFFFFFFFFFFFFFFFF | m
                path = xxhash.xxh64_intdigest(f"{bl}:{va}:{k}:{f & m}")
                row.append({"block": (bl * (budget + 1) + k + 1) & 0x7FFFFFFFFFFFFFFF, "value": path - (1 << 63), "used": now - (1 << 64) if now >> 63 else now})
            out.append(row)
        return pd.Series(out)

    return cells.select("fp", F.explode(deal("block", "value", "used", "fp")).alias("c")).select("c.block", "c.value", "c.used", "fp")


def first_deal(distinct: DataFrame, budget: int) -> DataFrame:
    """`dealt` for fingerprints that share no bits yet, as built-in functions."""
    n = -(-64 // (budget + 1))
    masks = [sum(1 << i for i in range(63, -1, -1)[k : k + n]) for k in range(0, 64, n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("block"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))).alias("value"), F.lit(m).cast("long").alias("used")) for k, m in enumerate(signed)])
    return distinct.select("fp", F.explode(cells).alias("c")).select("c.block", "c.value", "c.used", "fp")


def hamming_links(distinct: DataFrame, budget: int = 3, group: int = GROUP) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs within the budget. distinct: (fp), no repeats.

    group: at least 2 ** (budget + 1), so that a cell without bits to deal by is never above it.
    `value` is a 64-bit hash of the cell's bits: cells that clash share a trie, which costs time and alters nothing.
    """
    if group < 2 << budget:
        raise ValueError("a group this small may have no bits left to deal by")
    found = []
    cells = first_deal(distinct, budget)
    while True:
        cells = written(cells, "cells")
        sizes = cells.groupBy("block", "value").count()
        large = written(sizes.where(F.col("count") > group).select("block", "value"), "large")
        more = not large.isEmpty()
        own = cells.join(large, ["block", "value"], "left_anti") if more else cells
        dealt_rows = own.select("block", "value", "fp").repartition("block", "value").sortWithinPartitions("block", "value")
        found.append(written(dealt_rows.mapInPandas(lambda it: group_links(it, budget), "a long, b long").distinct(), "links"))
        if not more:
            break
        # where no free bits are left the fingerprints are equal, and equal ones are one row
        cells = dealt(cells.join(large, ["block", "value"], "left_semi"), budget)
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every linked node the smallest node of its component, by alternating large and small stars.

    Links and stars stay in written tables; only the count of changes reaches the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:  # each round brings every node nearer to the smallest of its component, so it ends
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small, "edges")
        # stars: no node has two parents and no parent has a parent
        parents = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        open_ = parents.where("n > 1").limit(1).count() or new.select(F.col("v").alias("p")).distinct().join(new.select(F.col("u").alias("p")), "p", "left_semi").limit(1).count()
        edges = new
        if not open_:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, budget: int = 3, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`."""
    rows = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = written(components(hamming_links(distinct.select("fp"), budget, group)), "roots")
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "least_id")
    ids = written(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "ids")
    of = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    known = written(distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "known")
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
