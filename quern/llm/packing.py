"""Best-fit packing of token sequences by large-item matching, on counts by length.

Documents are encoded in tasks and cut into pieces; a row of a piece has no tokens, only its length and a checksum. How pieces are
packed follows from how many there are of each length (at most `capacity` counts, however many documents), which is what the
driver gets. `plan` packs these counts:

* Pieces above one third of the capacity pair at most twice a bin: those above half open a bin each, and, smallest gap first, take
  the largest piece of a third to half that fits (gaps are nested, so no other matching has more pairs); what is left of these pairs
  with one another, longest first.
* Smaller pieces go longest first where the gap is smallest, as many to a bin as fit; a bin is opened where none has room.

Bins that look alike are one interval of numbers, so the plan is a list of runs: pieces `first`, `first + 1`, ... of a length go
into bins `bin`, `bin + 1`, ..., `each` to a bin from `offset` on. A length splits at most four intervals off, and a gap that
takes what fits is less than half of what it was, so there are less than 4 x capacity x log2(capacity) + capacity runs (about
92,000 for 2048): a size that no input exceeds, which may be broadcast. Pieces are numbered by ranges of (length, row) and joined
with the runs of their length; no length is gathered in one task.

Defined results: a null text is the empty text, which is the closing id alone; rows that repeat are packed each; a null id is kept;
texts are whole whatever their length; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ship_package, text_or_empty, written
from .units import Units, by_size

RUNS = "length int, first long, many long, bin long, each long, offset int"


class Bins:
    """Open bins by gap, as intervals (first bin, bins) that are alike."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.gaps: list[int] = []  # with bins, ascending

    def add(self, gap: int, first: int, bins: int) -> None:
        if bins and gap:
            if not self.open[gap]:
                insort(self.gaps, gap)
            self.open[gap].append((first, bins))

    def take(self, gap: int) -> tuple[int, int]:
        got = self.open[gap].pop()
        if not self.open[gap]:
            self.gaps.remove(gap)
        return got

    def fill(self, gap: int, first: int, bins: int, length: int, at: int, count: int, each: int) -> int:
        """Puts up to `each` pieces of a length, from number `at` on, into each of some bins; gives how many went in."""
        full, rest = divmod(min(count, each * bins), each)
        offset = self.capacity - gap
        if full:
            self.runs.append((length, at, full * each, first, each, offset))
            self.add(gap - each * length, first, full)
        if rest:
            self.runs.append((length, at + full * each, rest, first + full, each, offset))
            self.add(gap - rest * length, first + full, 1)
        self.add(gap, first + full + (rest > 0), bins - full - (rest > 0))
        return full * each + rest

    def opened(self, length: int, at: int, count: int, each: int) -> None:
        bins = -(-count // each)
        first, self.used = self.used, self.used + bins
        self.fill(self.capacity, first, bins, length, at, count, each)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, bins) for `counts` pieces by length, lengths from 1 to `capacity`."""
    bins, left = Bins(capacity), {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths go from 1 to the capacity")
    placed = dict.fromkeys(left, 0)

    def put(length: int, gap: int, each: int) -> None:
        first, many = bins.take(gap)
        n = bins.fill(gap, first, many, length, placed[length], left[length] - placed[length], each)
        placed[length] += n

    for n in sorted((n for n in left if 2 * n > capacity), reverse=True):
        bins.opened(n, 0, left[n], 1)
        placed[n] = left[n]
    halves = sorted((n for n in left if 3 * n > capacity >= 2 * n), reverse=True)
    for gap in [g for g in bins.gaps if 3 * g > capacity]:
        for n in halves:
            while n <= gap and placed[n] < left[n] and bins.open[gap]:
                put(n, gap, 1)
    # what is left of them, two to a bin; an odd one waits for the first of the next length
    waits: int | None = None
    for n in halves:
        if waits is not None and placed[n] < left[n]:
            put(n, waits, 1)
            waits = None
        if odd := (left[n] - placed[n]) % 2:
            left[n] -= 1
        if placed[n] < left[n]:
            bins.opened(n, placed[n], left[n] - placed[n], 2)
        if odd:
            first, bins.used = bins.used, bins.used + 1
            bins.fill(capacity, first, 1, n, left[n], 1, 1)
            waits = capacity - n
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while placed[n] < left[n] and bins.gaps and bins.gaps[-1] >= n:
            gap = next(g for g in bins.gaps if g >= n)
            put(n, gap, gap // n)
        if placed[n] < left[n]:
            bins.opened(n, placed[n], left[n] - placed[n], capacity // n)
    return bins.runs, bins.used


@lru_cache(maxsize=2)
def units_of(model: str) -> Units:
    return Units(model)


def encoded(texts: Sequence[str], units: Units, closing: int) -> Iterator[bytes]:
    """The ids of each text and the closing id, as little-endian 32-bit numbers. White space parts units."""
    numbers: dict[str, int] = {}
    places = [[numbers.setdefault(u, len(numbers)) for u in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")] for t in texts]
    ids, n = units.encode(list(numbers))
    blob, ends = ids.astype("<u4").tobytes(), [0, *(4 * n.cumsum()).tolist()]
    parts, end = [blob[a:b] for a, b in pairwise(ends)], closing.to_bytes(4, "little")
    for p in places:
        yield b"".join(map(parts.__getitem__, p)) + end


def pieces(docs: DataFrame, model_file: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, tag) of every piece, written; `tag` tells rows apart."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(model_file, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("struct<n:long,crcs:array<long>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        units, n, crcs, all_texts = units_of(model.value), [], [], texts.tolist()
        for s in by_size(all_texts):
            for ids in encoded(all_texts[s], units, closing):
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[a : a + 4 * capacity]) for a in range(0, len(ids), 4 * capacity)])
        return pd.DataFrame({"n": np.array(n, np.int64), "crcs": pd.Series(crcs, dtype=object)})

    rows = docs.select(F.col(id_col).alias("doc_id"), cut(text_or_empty(text_col)).alias("c"))
    rows = rows.select("doc_id", F.col("c.n").alias("n"), F.posexplode("c.crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * capacity
    rows = rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("length"), "ids_crc32")
    return written(rows.withColumn("tag", F.monotonically_increasing_id()), "pieces")


def placed(rows: DataFrame, capacity: int) -> DataFrame:
    """`rows` with `sequence_id` and `offset`; they have `length` (1 to `capacity`) and a `tag` that tells them apart, and are written."""
    spark = rows.sparkSession
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, starts, start = plan(counts, capacity)[0], {}, 0
    for n in sorted(counts):
        starts[n], start = start, start + counts[n]
    # numbers are over all lengths in ascending order, so a run of a length starts where its length does
    frame = spark.createDataFrame([(n, starts[n] + first, many, b, each, offset) for n, first, many, b, each, offset in runs], RUNS)
    frame = F.broadcast(frame.withColumnRenamed("offset", "run_offset").withColumnRenamed("length", "run_length"))
    at = numbered(rows, [F.col("length"), F.col("tag")])
    i = F.col("n") - F.col("first")
    met = at.join(frame, (F.col("length") == F.col("run_length")) & (i >= 0) & (i < F.col("many")))
    turn = F.pmod(i, F.col("each"))
    return met.withColumns({"sequence_id": F.col("bin") + F.expr("(n - first) div each"), "offset": F.col("run_offset") + turn * F.col("length")}).select(*rows.columns, "sequence_id", "offset")


def pack(docs: DataFrame, model_file: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of every document."""
    rows = placed(pieces(docs, model_file, capacity, id_col, text_col, closing), capacity)
    return rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
