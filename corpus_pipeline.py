"""Corpus pipeline: toxicity, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; what it returns is written and read again as the
next stage's `docs`. All stages but the last return the columns of their `docs`, whatever these are called.

* toxicity: documents that score at or above the threshold go.
* near_dedup: texts are linked if their five-word shingles have a similarity of at least 0.8 (SimHash links first, verified, then
  what they leave); of each group of linked texts the document with the smallest id stays, those without an id last. Rows
  that are equal in id and text count as one document; different texts under one id are different documents.
* decontamination: documents that overlap a benchmark item go.
* mixing: a document stays as many times as the mix uses it, rounded up where it is used in part.
* sharding: every row gets its `shard` and its `slot` in it; columns of these names that come in are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop_written, filter_of, free_name, made, may_have, table, text_or_empty, written
from quern.llm.decontamination import clean_documents
from quern.llm.mixing import copies
from quern.llm.near_copies import near_copy_groups
from quern.llm.sharding import cell_of, key_of, rendezvous, with_slots
from quern.llm.toxicity import THRESHOLD, fitted, scorer

SHARDS = 24


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = fitted(docs, table(spark, sf_dir, "labels"))
    return docs.where(scorer(lexicon, text_or_empty()) < THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text, number = text_or_empty(), F.col("doc_id").try_cast("long")
    keys = F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2")
    order = [F.col("doc_id").isNull().alias("no_id"), number.isNull().alias("odd"), F.coalesce(number, F.lit(0)).alias("num"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("word")]
    before = made()
    groups = written(near_copy_groups(docs.select(*keys, *order, text.alias("text"))), "groups")
    drop_written(spark, before, keep=1)
    # of a group the row that ranks first stays; of rows that are equal in id and text one
    stay = groups.groupBy("root").agg(F.min(F.struct("no_id", "odd", "num", "word", "k1", "k2")).alias("b")).select("b.k1", "b.k2")
    counts = groups.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    special = counts.join(stay.withColumn("stays", F.lit(True)), ["k1", "k2"], "left").withColumn("stays", F.coalesce("stays", F.lit(False))).where("n > 1 or not stays")
    special = written(special.select("k1", "k2", "stays"), "special")
    drop_written(spark, before, keep=1)
    # only rows that may go move: all others are told by the filter where they are read
    row = docs.select(F.struct(*columns_of(docs)).alias("row"), *keys)
    row = may_have(row, "k1", filter_of(special, "k1", special.count()))
    met = row.where("__may").join(special, ["k1", "k2"], "left")
    one = met.where("stays").dropDuplicates(["k1", "k2"])
    return row.where("not __may").select("row").unionByName(met.where("stays is null").select("row")).unionByName(one.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n = free_name(docs, "__copies")
    mixed = copies(docs, "doc_id", name=n).where(F.col(n) > 0)
    return mixed.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns_of(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, cell = key_of("doc_id"), free_name(docs, "__cell")
    rows = docs.drop("slot").withColumn("shard", rendezvous(key, [1.0] * SHARDS)).withColumn(cell, cell_of(key, text_or_empty()))
    return with_slots(rows, cell, ["doc_id", F.xxhash64(text_or_empty())])


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL has neither learnt scores nor links between near copies; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written for itself, and its input, go as soon as its output is written."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
