"""Exact dedup as a log-structured merge index, in DataFrame operations only.

* Each input task is a memtable. It is flushed as one run: rows (digest, id, length, row tag), sorted by digest. No
  shuffle takes place here and no text is written.
* Compaction merges `FAN` tables of a level into one of the next, until one is left: of each digest it keeps the row that
  ranks first (most code points, then smallest id) and the number of rows.
* Digests that several rows hit go into a bitmap filter, which is sized by their number. The runs are looked up by the
  filter: what it doesn't know stands alone and is answered in the task that reads the run. Only hits are joined with the
  compacted table, the few digests with a large part of all rows by broadcast. Above `MOST_BITS` all rows are joined.
* The texts of hits are read again and compared byte for byte, equal bytes being combined in the task that reads them. Digests
  that stand for several texts are grouped by their bytes instead.

Defined results: a null text is the empty text; a null id ranks after all others and may be a `keep_id` only where a
group has no other; exactly one row of a group is kept, also where rows repeat with their id; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BITS, PARTS, Filter, filter_of, may_have, text_or_empty, written

#: Tables that a compaction merges into one.
FAN = 16
WHITE_SPACE = " \t\n\x0b\x0c\r"


def without_white_space(text: Column) -> Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def memtable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), raw.alias("raw"), without_white_space(raw).alias("norm")).select(
        "id", "norm", F.char_length("raw").alias("n_points"), F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")
    )


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One sorted run for each input task, with the number of the run."""
    rows = memtable(docs, id_col, text_col).select(
        F.substring("sha", 1, digest_bytes).alias("digest"), "sha", "id", "n_points", F.monotonically_increasing_id().alias("tag"), F.spark_partition_id().alias("run")
    )
    return written(rows.sortWithinPartitions("digest"), "runs")


def rank_of() -> Column:
    """Most code points, then smallest id (null last), then the first of rows that repeat."""
    return F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("tag"))


def compact(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(digest, keep_id, keep_tag, group_size): the one table that is left when all levels are merged."""
    level = runs.select("digest", "run", rank_of().alias("best"), F.lit(1).cast("long").alias("group_size"))
    tables = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        tables = -(-tables // fan)
        level = level.groupBy("digest", F.floor(F.col("run") / fan).alias("run")).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        level = written(level, "level")
        if tables == 1:
            return level.select("digest", F.col("best.id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), "group_size")


def collided(docs: DataFrame, hits: Filter, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """Digests whose rows differ in their bytes."""
    rows = memtable(docs, id_col, text_col).select(F.substring("sha", 1, digest_bytes).alias("digest"), "norm")
    texts = may_have(rows, "digest", hits).where("__may").select("digest", "norm").distinct()
    return written(texts.groupBy("digest").count().where("count > 1").select("digest"), "collided")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, fan: int = FAN, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Texts are equal if they are identical without white space. Shorter digests (`digest_bytes`) give the same result by
    way of more byte comparisons.
    """
    runs = flush_runs(docs, id_col, text_col, digest_bytes)
    contested = written(compact(runs, fan).where("group_size > 1"), "contested")
    n, rows = contested.agg(F.count(F.lit(1)), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    hits = filter_of(contested, "digest", n, most_bits)
    bad = collided(docs, hits, id_col, text_col, digest_bytes)
    looked_up = may_have(runs, "digest", hits)
    alone = looked_up.where("not __may").select(*answer(False))
    met = looked_up.where("__may").drop("__may")
    large = F.col("group_size") > max(1000, rows // PARTS)
    often = F.broadcast(contested.where(large))
    rare = met.join(often.select("digest"), "digest", "left_anti").join(contested.where(~large), "digest", "left")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    out = alone.unionByName(met.join(often, "digest").select(*answer(True))).unionByName(rare.select(*answer(True)))
    if bad.isEmpty():
        return out.select(*columns)
    return out.join(bad, "digest", "left_anti").select(*columns).unionByName(by_bytes(docs, bad, id_col, text_col, digest_bytes))


def answer(known: bool) -> list[Column]:
    """The columns of a row of a run. known: whether it has been joined; a row without an entry in the compacted table stands alone."""
    out = [F.col("id").alias("doc_id"), F.lower(F.hex("sha")).alias("text_sha256"), "digest"]
    if not known:
        return [*out, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    alone = F.col("keep_tag").isNull()
    return [
        *out, F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
    ]


def by_bytes(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """The rows of collided digests, grouped by their bytes."""
    rows = memtable(docs, id_col, text_col).withColumn("digest", F.substring("sha", 1, digest_bytes))
    rows = written(rows.join(bad, "digest", "left_semi").withColumn("tag", F.monotonically_increasing_id()), "bytes")
    groups = rows.groupBy("norm").agg(F.min(rank_of()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "norm").select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best.tag")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
