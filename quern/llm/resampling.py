"""Importance resampling towards a target distribution, by hashed word features, without exploding scores.

* A document's features are its runs of one to `longest` words, hashed to `BUCKETS` buckets; higher-order functions make the array
  of its buckets where the text is read, once; the arrays are written.
* Of both corpora only the totals by bucket are shuffled (at most `BUCKETS` rows a task). The gain of each bucket follows from the
  totals; all gains together are one literal array in the plan.
* A document's weight is the floored mean of the gains that `element_at` finds for its buckets, summed by `aggregate` in place. A
  draw from a Gumbel distribution, which id and seed fix, is added; the documents with the highest scores are a sample without
  replacement in proportion to their weights.
* How many documents have each score (whole numbers; gains are logarithms of counts in thousandths, so there are some 100,000 scores at most,
  whatever the input) tells the score at the threshold. Only what reaches it is dealt by ranges and numbered; all other
  documents have no rank and don't move.

Defined results: a null text has no words, no features and weight 0; a null id counts as the empty word in the draw and ranks after
others of its score; rows that repeat are documents of their own, in any order among themselves; other columns are ignored; without target texts gains
follow from the source alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, ship_package, text_or_empty, written

BUCKETS = 10_000
#: What parts words, which are runs of digits, small letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words after A to Z became a to z; other capitals stay."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower())), BETWEEN), "")


def buckets_of(words: Column, longest: int = 2, buckets: int = BUCKETS) -> Column:
    """The bucket (from 0) of every run of up to `longest` words."""
    n, runs, parts = F.size(words), words, []
    for k in range(1, longest + 1):
        if k > 1:
            many = F.greatest(n - F.lit(k - 1), F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), many), F.slice(words, F.lit(k), many), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(F.transform(runs, lambda r: (F.crc32(r.cast("binary")) % buckets).cast("int")))
    return F.concat(*parts)


def totals(rows: DataFrame, buckets: int) -> list[int]:
    """Features by bucket; `buckets` numbers come to the driver."""
    # not `explode`, for which the optimizer would add a filter that makes the arrays several times over
    counts = rows.select(F.explode_outer("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    out = [0] * buckets
    for b, n in counts:
        if b is not None:
            out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Of each bucket: the logarithm of its share in the target by its share in the source, both counted one up, in thousandths."""
    n, s, t = len(source), float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((float(target[b] + 1) * s) / (float(source[b] + 1) * t))) for b in range(n)]


def featured(docs: DataFrame, text_col: str, longest: int, buckets: int, *others: Column) -> DataFrame:
    """`others`, n_words and the buckets of every row, written: texts are read once."""
    rows = docs.select(*others, words_of(text_or_empty(text_col)).alias("words"))
    rows = rows.withColumns({"n_words": F.size("words"), "buckets": buckets_of(F.col("words"), longest, buckets)}).drop("words")
    return written(rows, "buckets", compression="zstd")


def gumbel(key: Column, seed: int) -> Column:
    """A whole number, the same for a key whenever it is drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(rows: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every row of (doc_id, n_words, buckets)."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("doc_id", "n_features", "n_words", mean.alias("weight"))
    return rows.withColumn("score", F.col("weight") + gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed))


def drawn(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """`rows` with `rank`: from 1 for the `percent` hundredths with the highest scores of those with enough words, null for all others."""
    may = F.col("n_words") >= least_words
    scores = sorted(((r["score"], r["count"]) for r in rows.where(may).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in scores) // 100
    least, n = None, 0
    for score, many in scores:
        if n >= wanted:
            break
        least, n = score, n + many
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select(*rows.columns, none)
    reach = may & (F.col("score") >= least)
    first = numbered(rows.where(reach), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tag")], "n")
    rank = F.when(F.col("n") < wanted, F.col("n") + 1).alias("rank")
    return first.select(*rows.columns, rank).unionByName(rows.where(~reach).select(*rows.columns, none))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of `docs`, drawn towards the texts of `target`."""
    ship_package(docs.sparkSession)
    source = featured(docs, text_col, longest, buckets, F.col(id_col).alias("doc_id"))
    aim = featured(target, target_col, longest, buckets)
    rows = scored(source, gains(totals(source, buckets), totals(aim, buckets)), seed).withColumn("tag", F.monotonically_increasing_id())
    return drawn(written(rows, "scores"), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", F.col("n_words").cast("long").alias("n_words"))
