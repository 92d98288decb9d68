"""Benchmark decontamination by spaced seeds.

A fixed mask ignores some positions of a window of words. The words of every test window that the mask keeps are hashed;
training windows with the same hash are hits. Around hits, test item and document are laid over each other and compared
word by word: a stretch of at least `MIN_WORDS` words (or the whole item, where that is shorter) of which at least
`MATCH` agree is an overlap. Substituted words therefore neither prevent the hit nor the overlap. An overlap gives `LEAST_HITS`
hits at least on the same line (the same item at the same shift), so lines with fewer are left out before any comparison; words
that many items share give many lines, but few hits on each. Items of fewer than `LEAST_WORDS` words must occur whole.

Test items are indexed in blocks of a bounded number of words. One block is broadcast at a time: with more than one, each takes a
pass over the documents that writes the overlaps it finds by the hash of the text, and the tables are joined to the
documents that have any. Within a document the lines of at most about `LINES` hits are held at once.

Words are what stands between white space; characters of scripts that are written without spaces are words of their own.

Defined results: a null text is the empty text; items without words are never found; rows that repeat get the same
result; other columns stay apart; an empty table on either side gives no overlap.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_of, free_name, may_have, ship_package, text_or_empty, written

# 1 is a position that counts. Where a stretch of 5 words or more agrees in 80 %, some 5 words of it in a row
# have one difference at most, or else there were 2 in each 5; these masks hit all such words, so no overlap is missed.
MASKS = ("1111", "11011", "10111", "11101")
MIN_WORDS = 12
LEAST_WORDS = 5
MATCH = 0.8
# The fewest hits of all masks on an overlap, by the words of the item (12 and more: any stretch that counts).
LEAST_HITS = {5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 2, 11: 4, 12: 6}
#: Words that agree at least in any overlap of an item that need not occur whole.
LEAST_KNOWN = math.ceil(MATCH * LEAST_WORDS)
BLOCK_WORDS = 200_000
LINES = 2_000_000
#: Words that a worker keeps, and the longest of them.
KEPT, KEPT_LETTERS = 200_000, 48
EDGES = ".,;:!?\"'`()[]{}<>#$%&*|-_=+/\\~^«»“”‘’…¡¿、。，！？：；（）「」『』"
#: Thai, Lao, Myanmar, Khmer, kana and ideographs.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def raw_words(text: str) -> list[str]:
    if not text.isascii():
        try:
            text.encode("latin-1")  # much faster than looking for such characters
        except UnicodeEncodeError:
            text = UNSPACED.sub(r" \g<0> ", text)
    return text.split()


def plain(word: str) -> str:
    return word.strip(EDGES).lower()


class Ids(dict):
    """Id of a word as it stands in a text; 0 if no test item has it."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        bare = plain(word)
        n = self.vocabulary.get(bare, 0) if bare else -1
        if len(word) <= KEPT_LETTERS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


class SeedIndex:
    """The spaced-seed hashes of a block of test items."""

    def __init__(self, items: Sequence[tuple[object, str]]) -> None:
        vocabulary: dict[str, int] = {}
        self.items, self.words = [], []
        for item, text in items:
            words = [w for w in map(plain, raw_words(text or "")) if w]
            if words:
                self.items.append(item)
                self.words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
        self.ids = Ids(vocabulary)
        self.odd = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.longest, self.least_known = int(sizes.max(initial=0)), min(LEAST_KNOWN, int(sizes.min(initial=LEAST_KNOWN)))
        self.least_hits = np.array([LEAST_HITS.get(min(n, MIN_WORDS), 1) for n in sizes.tolist()], np.int64)
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for i, words in enumerate(self.words):
            for mask in MASKS if len(words) >= LEAST_WORDS else ():
                h, ok = self.seeds(words, mask)
                at = np.flatnonzero(ok)
                hashes.append(h[at])
                places.append(np.column_stack([np.full(len(at), i), at]))
        self.hashes, self.places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        #: items of few words by their words
        self.whole: dict[tuple[int, ...], list[int]] = {}
        for i, words in enumerate(self.words):
            if len(words) < LEAST_WORDS:
                self.whole.setdefault(tuple(words.tolist()), []).append(i)

    def seeds(self, words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows under a mask, and which have only known words where the mask counts."""
        n = len(words) - len(mask) + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, ok, w = np.full(n, int(mask, 2), np.uint64), np.ones(n, bool), words.astype(np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                h = (h ^ w[k : k + n]) * self.odd[k]
                h ^= h >> np.uint64(29)
                ok &= words[k : k + n] > 0
        h *= self.odd[15]
        return h, ok

    def lines(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shift) with as many hits as an overlap has; a line may come twice."""
        found = []
        for mask in MASKS:
            h, ok = self.seeds(words, mask)
            ok &= self.sieve[(h >> np.uint64(44)).astype(np.int64)]
            at = np.flatnonzero(ok)
            lo, hi = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
            found.append(np.column_stack([at, lo, hi - lo])[hi > lo])
        todo = [np.concatenate(found)]
        while todo:
            hits = todo.pop()
            if not len(hits):
                continue
            at, lo, n = hits.T
            first, last, total = int(at.min()), int(at.max()), int(n.sum())
            if total > LINES and last - first > 2 * self.longest:
                middle = (first + last) // 2  # all hits of a line lie within the longest item, so one side has them all
                todo += [hits[at < middle + self.longest], hits[at >= middle]]
                continue
            which = np.repeat(np.arange(len(n)), n)
            place = self.places[lo[which] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)]
            width = len(words) + self.longest + 1
            line, count = np.unique(place[:, 0] * width + (at[which] - place[:, 1] + self.longest), return_counts=True)
            line = line[count >= self.least_hits[line // width]]
            yield from zip((line // width).tolist(), (line % width - self.longest).tolist(), strict=True)

    def overlaps(self, text: str) -> dict[int, int]:
        """Longest overlap in words by item number."""
        if not self.items or not text:
            return {}
        raw = raw_words(text)
        words = np.fromiter(map(self.ids.__getitem__, raw), np.int64, len(raw))
        words = words[words >= 0]  # without words that are only punctuation
        if np.count_nonzero(words) < self.least_known:
            return {}
        out: dict[int, int] = {}
        for i, d in self.lines(words) if len(self.hashes) else ():
            if n := stretch(self.words[i], words, d):
                out[i] = max(out.get(i, 0), n)
        for n in sorted({len(w) for w in self.whole}):
            known = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(words, n).all(axis=1)) if len(words) >= n else ()
            for w in {tuple(words[p : p + n].tolist()) for p in known} & self.whole.keys():
                out |= dict.fromkeys(self.whole[w], n)
        return out


def stretch(item: np.ndarray, words: np.ndarray, shift: int) -> int:
    """The longest stretch that counts as an overlap of an item laid over a document at `shift`; 0 if none does."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    least = min(MIN_WORDS, len(item))
    if b - a < least:
        return 0
    same = item[a:b] == words[a + shift : b + shift]
    if same.sum() < MATCH * least:
        return 0
    run = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - MATCH, -MATCH))])
    first = np.minimum.accumulate(run)  # the earliest start from which the share reaches MATCH is where the minimum is low enough
    ends = np.arange(len(run))
    starts = np.searchsorted(-first, -run - 1e-9)
    n = int((ends - starts).max())
    return n if n >= least else 0


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The test items in blocks of at most about BLOCK_WORDS words, without holding more than a block on the driver."""
    block, n = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        n += len((r[1] or "").split())
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def overlap_udf(index: Broadcast, item_type: str) -> Callable[[Column], Column]:
    @F.pandas_udf(f"array<struct<item:{item_type},words:int>>")
    def overlaps(texts: pd.Series) -> pd.Series:
        s = index.value
        return pd.Series([[{"item": s.items[i], "words": n} for i, n in sorted(s.overlaps(t).items())] for t in texts])

    return overlaps


def with_overlaps(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with the column `name`: array of (item, words) of the overlaps of a text."""
    spark = docs.sparkSession
    ship_package(spark)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    text = text_or_empty(text_col)
    first, *more = [*two(blocks(benchmark, item_col, item_text))]
    if not more:
        return docs.withColumn(name, overlap_udf(spark.sparkContext.broadcast(SeedIndex(first)), item_type)(text))
    tables = None
    for block in blocks(benchmark, item_col, item_text):
        index = spark.sparkContext.broadcast(SeedIndex(block))
        found = docs.select(F.sha2(text, 256).alias("key"), overlap_udf(index, item_type)(text).alias("found")).where(F.size("found") > 0)
        found = written(found.groupBy("key").agg(F.first("found").alias("found")), "overlaps")
        index.destroy()
        tables = found if tables is None else tables.unionByName(found)
    key, may = free_name(docs, "__key"), free_name(docs, "__may")
    every = written(tables.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias(name)), "all-overlaps")
    rows = may_have(docs.withColumn(key, F.sha2(text, 256)), key, filter_of(every, key, every.count()), may)
    none = F.array().cast(f"array<struct<item:{item_type},words:int>>")
    met = rows.where(F.col(may)).join(every, key, "left").withColumn(name, F.coalesce(name, none))
    return rows.where(~F.col(may)).withColumn(name, none).unionByName(met).drop(may, key)


def two(found: Iterator[list]) -> Iterator[list]:
    """At most two of the blocks; an empty one if there is none."""
    yield next(found, [])
    yield from [b for b in (next(found, None),) if b is not None]


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` without an overlap, as they are."""
    name = free_name(docs, "__overlaps")
    return with_overlaps(docs, benchmark, name, text_col).where(F.size(name) == 0).drop(name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, overlap_words, items) of every row; items: ids of the test items found, ascending."""
    rows = with_overlaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "found")
    return rows.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["words"])), F.lit(0)).cast("long").alias("overlap_words"),
        F.array_sort(F.transform("found", lambda x: x["item"])).alias("items"),
    )
