"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a record from the record's key alone, and the record goes to the shard with the largest
draw. A further shard can only win records for itself; all others stay where they are.

Defined results: a null key is a key of its own; rows that repeat go to the same shard and get slots of their own; a
null text has size `overhead` and the checksum of the empty text; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, written

#: Cells into which the records of a shard are dealt for numbering; no task orders more than a cell at a time.
CELLS = 4096
SEED = 20240229


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) with u in (0, 1) from key and shard."""
    u = (F.pmod(F.xxhash64(key, shard, F.lit(SEED)), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -weight / F.ln(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key. A shard of weight 0 gets nothing while another has weight."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("shards need weights of 0 or more, one of them above 0")
    if len(set(weights)) == 1:  # the same order as that of the weighted draws, without logarithms
        draws = [F.struct(F.pmod(F.xxhash64(key, F.lit(s), F.lit(SEED)), F.lit(1 << 52)).alias("d"), F.lit(-s).alias("s")) for s in range(len(weights))]
    else:
        draws = [F.struct(draw(key, F.lit(s), F.lit(float(w))).alias("d"), F.lit(-s).alias("s")) for s, w in enumerate(weights) if w > 0]
    best = F.array_max(F.array(*draws))
    return (-best["s"]).cast("int")


def with_slots(rows: DataFrame, cell: str, order: Sequence[str | Column]) -> DataFrame:
    """`slot`: gapless numbers from 0 within each shard, in the order of (cell, order). The column `cell` goes.

    Counts by shard and cell are summed up first, so that each cell is numbered on its own. Their number is bounded by
    shards x cells, which is what is broadcast.
    """
    n, start, at = (free_name(rows, x) for x in ("__n", "__start", "__at"))
    counts = rows.groupBy("shard", cell).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy("shard").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    numbered = rows.withColumn(at, F.row_number().over(W.partitionBy("shard", cell).orderBy(*order)))
    return numbered.join(F.broadcast(starts), ["shard", cell]).withColumn("slot", F.col(start) + F.col(at) - 1).drop(cell, start, at)


def cell_of(key: Column, text: Column, cells: int = CELLS) -> Column:
    """Rows of one key are dealt by their texts too, as ids may repeat or be null."""
    return F.pmod(F.xxhash64(key, text, F.lit(SEED + 1)), F.lit(cells))


def key_of(key_col: str) -> Column:
    """The key as a string; a null is apart from the empty string."""
    return F.coalesce(F.col(key_col).cast("string"), F.lit("\0null"))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, key_col: str = "doc_id", text_col: str = "text", overhead: int = 8, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`; `grown_shard` with one more shard of mean weight."""
    text, key = text_or_empty(text_col), key_of(key_col)
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"), cell_of(key, text, cells).alias("cell"),
    )
    # texts are read once; numbering works on the narrow rows
    return with_slots(written(rows, "shards"), "cell", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
