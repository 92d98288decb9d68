"""Odd documents that every operator has to cope with."""

from __future__ import annotations

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, keep_id long, fp long"


def odd_rows() -> list[tuple]:
    long = "lorem ipsum dolor " * 20_000
    texts = [None, "", " \t\n", "a", "a", "A  b\nc", "a b c", "aB c", long, long + "x", "x" * 50_000, "ä ö ü 😀 中文", "one two three four five six"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 1, 2, 0.5, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[3], rows[12], (None, "a", None, None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None, None)]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def more_docs(spark):
    """A thousand documents."""
    return documents(spark, "/root/testdata/sf0.01")
