"""Alignment of the tokens of two vocabularies by their bytes.

`mapInPandas` encodes texts both ways and merges the two ascending lists of token ends: where both end a group is cut, and every
step of the merge is one link, the two tokens that the pointers stand at. What lies between single spaces is a unit that no token
spans, so unit ends are group ends and each different unit of a batch is encoded and merged once; a text with other white space
next to a space is a unit as a whole. Of each document its groups go out as a checksum, its links as distinct pairs of ids with
their number.

Spark counts the documents of each pair, takes the highest count on either side (a row for each id of a vocabulary) and joins both
back. Pairs that most documents have are few, by construction at most `FREQUENT`: these are joined where the documents' pairs are read, all others by shuffle.

Defined results: a text that is null or empty, or whose tokens of either side don't spell it byte for byte after a space, has no
tokens; strings of special tokens are plain text; rows that repeat are documents of their own; a null id is kept; texts are whole
whatever their length; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, written
from .token_counts import model_bytes
from .units import Units, by_size

#: Ids of the second vocabulary are below this, so that a pair of ids is one number.
SIDE = 1 << 15
#: Pairs that are broadcast.
FREQUENT = 200_000
SPACE = "▁"
#: Where a space doesn't simply begin the next unit.
OTHER_SPACE = re.compile(r"\s | \s| \Z|\A ")
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


class Pieces:
    """A sentencepiece vocabulary that puts a space before each text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        #: The bytes of each id.
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lead = np.array([p.startswith(SPACE) for p in pieces])
        #: Whether each space begins a token.
        self.parts = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, each after a space, and how many each has."""
        single = self.parts and not any(" " in u for u in units)
        if units and single and all(units):
            ids = np.array(self.library.encode(" ".join(units)), np.int64)
            starts = np.flatnonzero(self.lead[ids])
            if len(starts) == len(units) and starts[0] == 0:
                return ids, np.diff(np.append(starts, len(ids)))
        each = self.library.encode(list(units), num_threads=1) if units else []
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)


@dataclass
class Vocabularies:
    a: Units
    b: Pieces

    def __post_init__(self) -> None:
        n = 1 + max(self.a.bytes)
        if len(self.b.bytes) > SIDE or n * SIDE > 1 << 31:
            raise ValueError("vocabularies of more ids than a pair of them has room for")
        self.a_bytes = [self.a.bytes.get(i, b"") for i in range(n)]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b.bytes))
        # what each token adds to the groups of a document, by id, side and whether it is the last of its side in the group
        self.written = np.array([f"{i}{end}" for ids, last in ((n, "|"), (len(self.b.bytes), ";")) for i in range(ids) for end in (",", last)], dtype=object)


@lru_cache(maxsize=2)
def vocabularies(a: str, b: bytes) -> Vocabularies:
    return Vocabularies(Units(a, special_as_text=True), Pieces(b))


@dataclass
class Merged:
    """Units after the merge: counts by unit, links one unit after another, groups as text; `whole` is false where a side doesn't spell the unit."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: list[str]


def merged(units: Sequence[str], v: Vocabularies) -> Merged:
    """Encodes units, each after a space, both ways and merges the ends of their tokens."""
    spelt = [b" " + u.encode() for u in units]
    (a, n_a), (b, n_b) = v.a.encode(units, " "), v.b.encode(units)
    whole = np.ones(len(units), bool)
    text = b"".join(spelt)
    if b"".join(map(v.a_bytes.__getitem__, a.tolist())) != text or b"".join(map(v.b.bytes.__getitem__, b.tolist())) != text:
        for ids, n, of in ((a, n_a, v.a_bytes), (b, n_b, v.b.bytes)):
            ends, all_ids = np.cumsum(n).tolist(), ids.tolist()
            whole &= [b"".join(map(of.__getitem__, all_ids[s:e])) == t for (s, e), t in zip(pairwise([0, *ends]), spelt)]
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a * whole, n_b * whole
        spelt = [t if w else b"" for t, w in zip(spelt, whole)]
    size = np.array([len(t) for t in spelt], np.int64)
    end_a, end_b, end_unit = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b]), np.cumsum(size)
    length = int(end_unit[-1]) if len(units) else 0
    in_a, in_b = np.zeros(length + 1, bool), np.zeros(length + 1, bool)
    in_a[end_a] = True
    in_b[end_b] = True
    # a step of the merge ends where either side does; the pointers stand at as many tokens as have ended before
    steps, cuts = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
    links = a[(np.cumsum(in_a) - in_a)[steps]] * SIDE + b[(np.cumsum(in_b) - in_b)[steps]]
    n_links, n_groups = (np.diff(np.concatenate([[0], np.searchsorted(x, end_unit, "right")])) for x in (steps, cuts))
    # groups: tokens in the order of (group, side), each with the sign that follows it
    of_a, of_b = np.searchsorted(cuts, end_a, "left"), np.searchsorted(cuts, end_b, "left")
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (of_a, of_b))
    code = np.concatenate([a * 2 + last_a, (b + len(v.a_bytes)) * 2 + last_b])
    order = np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")
    tokens = v.written[code[order]].tolist()
    ends = np.cumsum(n_a + n_b).tolist()
    return Merged(whole, n_a, n_b, n_groups, n_links, links, ["".join(tokens[s:e]) for s, e in pairwise([0, *ends])])


def units_of(text: str) -> list[str]:
    return [text] if OTHER_SPACE.search(text) else text.split(" ")


def aligned(texts: Sequence[str | None], v: Vocabularies) -> pd.DataFrame:
    """A row of `ALIGNED` for each text."""
    numbers: dict[str, int] = {}
    places = [[numbers.setdefault(u, len(numbers)) for u in units_of(t)] if t else [] for t in texts]
    m = merged(list(numbers), v)
    of = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    unit = np.array([i for p in places for i in p], np.int64)
    bad = np.zeros(len(texts), bool)
    bad[of[~m.whole[unit]]] = True
    of, unit = of[~bad[of]], unit[~bad[of]]
    sums = {c: np.bincount(of, x[unit], len(texts)).astype(np.int64) for c, x in (("n_a", m.n_a), ("n_b", m.n_b), ("n_groups", m.n_groups), ("n_links", m.n_links))}
    spoken = [("".join(map(m.groups.__getitem__, p)) if not b else "") for p, b in zip(places, bad)]
    # distinct units of each document, then their links, then distinct pairs with their number
    seen, often = np.unique(of * max(1, len(numbers)) + unit, return_counts=True)
    of, unit = np.divmod(seen, max(1, len(numbers)))
    n = m.n_links[unit]
    start = (np.cumsum(m.n_links) - m.n_links)[unit]
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = np.repeat(of, n) << 31 | m.links[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.add.reduceat(np.repeat(often, n)[order], first) if len(first) else np.zeros(0, np.int64)
    key = key[first]
    ends = np.searchsorted(key, np.arange(1, len(texts)) << 31)
    hashed = [hashlib.sha256(s[:-1].encode()).hexdigest() if s else "" for s in spoken]
    pairs, many = (np.split(x.astype(np.int32), ends) if len(texts) else [] for x in (key & ((1 << 31) - 1), times))
    return pd.DataFrame(sums | {"groups_sha256": hashed, "pairs": pairs, "times": many})


def pairs_of(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag) and `ALIGNED` of every row, written; `tag` tells rows apart."""
    spark = docs.sparkSession
    ship_package(spark)
    models = spark.sparkContext.broadcast((model_bytes(a_file).decode(), model_bytes(b_file)))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabularies(*models.value)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), None).tolist()
            for s in by_size([t or "" for t in texts]):
                out = aligned(texts[s], v)
                out.insert(0, "doc_id", batch["doc_id"].iloc[s].tolist())
                yield out

    kind = docs.select(id_col).schema[0].dataType
    # ids go as text: a column of numbers with nulls would come back rounded
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(align, f"doc_id string, {ALIGNED}")
    return written(rows.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("tag", F.monotonically_increasing_id()), "aligned", compression="zstd")


def pair_statistics(found: DataFrame) -> DataFrame:
    """(pair, n, best_a, best_b): how many documents have a pair linked, and whether that is the most of its ids on either side."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a, b = F.expr(f"pair div {SIDE}"), F.expr(f"pair % {SIDE}")
    for side, id_of in (("a", a), ("b", b)):
        most = counts.groupBy(id_of.alias("id")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
        counts = counts.withColumn("id", id_of).join(F.broadcast(most), "id").withColumn(f"best_{side}", F.col("n") == F.col("most")).drop("id", "most")
    return counts


def often_from(counts: DataFrame, most: int) -> float:
    """The least count of which it is certain that at most `most` pairs have it or more."""
    step = F.ceil(F.log2("n") * 4)
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # four rows for each power of two
    total, least = 0, float("inf")
    for s, n in steps:
        total += n
        if total > most:
            break
        least = 2 ** ((s - 1) / 4)
    return least


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b) of every row.

    n_best, n_best_b: links whose pair more documents have than any other pair of their first, their second id, ties included.
    """
    found = pairs_of(docs, a_file, b_file, id_col, text_col)
    statistics = written(pair_statistics(found), "pair-statistics")
    least = often_from(statistics, frequent)
    links = found.select("tag", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("tag", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    often = F.broadcast(statistics.where(F.col("n") > least))
    rest = links.join(often.select("pair"), "pair", "left_anti").join(statistics.where(F.col("n") <= least), "pair")

    def summed(rows: DataFrame) -> DataFrame:
        best = [F.sum(F.when(F.col(f"best_{s}"), F.col("times")).otherwise(0).cast("long")).alias(c) for s, c in (("a", "n_best"), ("b", "n_best_b"))]
        return rows.groupBy("tag").agg(*best, F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    sums = summed(links.join(often, "pair")).unionByName(summed(rest)).groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")])
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(sums, "tag", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", F.coalesce("n_best_b", zero).alias("n_best_b")
    )
