"""Column tests of whole layers, compiled into few passes.

What is asked of a table (columns without nulls, keys that don't repeat, foreign keys) is grouped by the exchange that it needs:

* Nulls need none. They ride along with the first key of the table, whose groups carry the null counts of their rows; a table without a
  key to test answers them in its foreign-key pass, or in a plain aggregate.
* Each key is one exchange by that key. Rows of a group are combined before it, so a value that repeats costs no task more.
* All foreign keys of a table share one pass over it, joined to the different keys of each parent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import all_checks, counters


@dataclass(frozen=True)
class Tests:
    """What holds for a table. keys: columns of each key. parents: (column, parent table, its column)."""

    __test__ = False  # no test case
    not_null: Sequence[str] = ()
    keys: Sequence[Sequence[str]] = ()
    parents: Sequence[tuple[str, str, str]] = ()

    def __post_init__(self) -> None:
        for what in (self.not_null, [tuple(k) for k in self.keys], self.parents):
            if len(set(what)) != len(what):
                raise ValueError(f"asked twice: {what}")
        if any(not k or isinstance(k, str) for k in self.keys):
            raise ValueError("a key is a list of columns")


def names(table: str, t: Tests) -> list[str]:
    """The names of a table's tests."""
    return [f"not_null_{table}_{c}" for c in t.not_null] + [f"unique_{table}_{'_'.join(k)}" for k in t.keys] + [f"relationship_{table}_{c}" for c, _, _ in t.parents]


def null_counts(table: str, t: Tests) -> dict[str, Column]:
    return {f"not_null_{table}_{c}": F.count_if(F.col(c).isNull()) for c in t.not_null}


def rows_of(one: DataFrame) -> DataFrame:
    """A row of counts as (check_name, failures)."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("failures")) for n in one.columns])).alias("c")).select("c.*")


def key_pass(table: str, df: DataFrame, key: Sequence[str], carried: Mapping[str, Column]) -> DataFrame:
    """One exchange: rows by key, with the counts that ride along. Rows that lack a part of the key are in groups of their own, which never repeat."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in carried.items()])
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return rows_of(groups.agg(*[F.sum(n).alias(n) for n in carried], F.count_if(whole & (F.col("__n") > 1)).alias(f"unique_{table}_{'_'.join(key)}")))


def parent_pass(table: str, df: DataFrame, t: Tests, tables: Mapping[str, DataFrame], carried: Sequence[str]) -> DataFrame:
    """One pass over the child for all its foreign keys. Nulls are no orphans."""
    rows = df.select(*dict.fromkeys([c for c, _, _ in t.parents] + list(carried)))
    checks = {f"not_null_{table}_{c}": F.col(c).isNull() for c in carried}
    for i, (column, parent, key) in enumerate(t.parents):
        keys = tables[parent].select(F.col(key).alias(f"__key{i}")).where(F.col(f"__key{i}").isNotNull()).distinct().withColumn(f"__there{i}", F.lit(True))
        rows = rows.join(keys, F.col(column) == F.col(f"__key{i}"), "left")
        checks[f"relationship_{table}_{column}"] = F.col(column).isNotNull() & F.col(f"__there{i}").isNull()
    return counters(rows, checks)


def compiled(tables: Mapping[str, DataFrame], tests: Mapping[str, Tests]) -> list[DataFrame]:
    """The passes, each a frame of (check_name, failures)."""
    passes = []
    for table, t in tests.items():
        df, nulls = tables[table], null_counts(table, t)
        for i, key in enumerate(t.keys):
            passes.append(key_pass(table, df, key, nulls if i == 0 else {}))
        carried = t.not_null if not t.keys else ()
        if t.parents:
            passes.append(parent_pass(table, df, t, tables, carried))
        elif carried:
            passes.append(rows_of(df.agg(*[c.alias(n) for n, c in nulls.items()])))
    return passes


def answers(tables: Mapping[str, DataFrame], tests: Mapping[str, Tests]) -> DataFrame:
    """(check_name, failures) of all tests: a row for each."""
    return all_checks(*compiled(tables, tests))
