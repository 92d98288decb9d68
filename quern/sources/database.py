"""Tables of a relational database whose driver is on the class path: scans in parts, aggregates that the database answers, and loads
that become current in one transaction.

Scans and aggregates go through Spark's JDBC catalogue, so filters, columns, limits and aggregates are pushed by the optimizer. A
load is written beside its target over several connections, checked by the database itself, and then takes the target's name; readers see the old table or the new one. A crash leaves the target as it was, and the next load starts anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalar import checked_identifier
from quern.operators.quality import QualityError

CATALOGUE = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
#: Rows that go to the database at once, and connections that write.
BATCH, WRITERS = 5000, 4


@dataclass(frozen=True)
class Database:
    """A database by its URL; `schema` holds the tables. properties: driver, user, password and what else the driver takes."""

    spark: SparkSession
    url: str
    schema: str = "STAGING"
    properties: Mapping[str, str] = field(default_factory=dict)

    # names and connections -----------------------------------------------------------------------------------------

    @property
    def dialect(self):
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)

    def quoted(self, *names: str) -> str:
        return ".".join(self.dialect.quoteIdentifier(n) for n in names)

    def named(self, table: str) -> str:
        return self.quoted(self.schema, checked_identifier(table))

    def rename(self, table: str, to: str) -> str:
        """The new name is quoted, or a database would fold its case."""
        verb = "RENAME TABLE {} TO {}" if self.url.startswith(("jdbc:derby:", "jdbc:db2:", "jdbc:mysql:")) else "ALTER TABLE {} RENAME TO {}"
        return verb.format(self.named(table), self.quoted(checked_identifier(to)))

    def options(self) -> dict[str, str]:
        return {"url": self.url, "preferTimestampNTZ": "true", **self.properties}

    @contextmanager
    def connection(self):
        """One transaction: committed at the end, rolled back when anything fails."""
        jvm = self.spark._jvm
        said = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap({**self.options(), "dbtable": self.quoted(self.schema)}))
        c = self.dialect.createConnectionFactory(said).apply(-1)
        try:
            c.setAutoCommit(False)
            yield c
            c.commit()
        except BaseException:
            c.rollback()
            raise
        finally:
            c.close()

    @staticmethod
    def run(connection, *statements: str) -> None:
        for s in statements:
            statement = connection.createStatement()
            try:
                statement.execute(s)
            finally:
                statement.close()

    def has(self, connection, table: str) -> bool:
        found = connection.getMetaData().getTables(None, self.schema, table, None)
        try:
            return found.next()
        finally:
            found.close()

    def create_schema(self) -> None:
        with self.connection() as c:
            found = c.getMetaData().getSchemas(None, self.schema)
            if not found.next():
                self.run(c, f"CREATE SCHEMA {self.quoted(self.schema)}")

    def exists(self, table: str) -> bool:
        with self.connection() as c:
            return self.has(c, table)

    # reading -------------------------------------------------------------------------------------------------------

    @property
    def catalogue(self) -> str:
        """The database as a catalogue of the session."""
        name = f"database_{zlib.crc32(repr((self.url, sorted(self.properties.items()))).encode()):08x}"
        key = f"spark.sql.catalog.{name}"
        if self.spark.conf.get(key, None) is None:
            for k, v in self.options().items():
                self.spark.conf.set(f"{key}.{k}", v)
            self.spark.conf.set(key, CATALOGUE)
        return name

    def table(self, name: str, **options: str) -> DataFrame:
        """A table whose filters, columns, limits and aggregates the optimizer pushes into the database."""
        return self.spark.read.options(**options).table(f"{self.catalogue}.`{self.schema}`.`{checked_identifier(name)}`")

    def scan(self, name: str, column: str, parts: int) -> DataFrame:
        """The table in `parts` ranges of a column of numbers or dates, each over a connection of its own. The bounds are an aggregate that the
        database answers; they only place the ranges, no row is left out, and rows without a value are in the first."""
        kind = self.table(name).schema[column].dataType
        if not isinstance(kind, (T.NumericType, T.DateType)):
            raise ValueError(f"{name}.{column} is {kind.simpleString()}, which has no ranges")
        low, high = self.table(name).agg(F.min(column).cast("string"), F.max(column).cast("string")).first()
        if low is None or low == high or parts < 2:
            return self.table(name)
        return self.table(name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(parts))

    def query(self, sql: str) -> DataFrame:
        """What the database answers to a statement of its own."""
        return self.spark.read.format("jdbc").options(**self.options(), query=sql).load()

    # writing -------------------------------------------------------------------------------------------------------

    def write(self, rows: DataFrame, name: str, compared: Sequence[str] = (), writers: int = WRITERS, compared_type: str = "VARCHAR(255)") -> None:
        """Replaces a table, over at most `writers` connections. Strings in `compared` get a type that the database can compare and group by, all others one without a limit."""
        types = ", ".join(f"{c} {compared_type}" for c in dict.fromkeys(compared) if isinstance(rows.schema[c].dataType, T.StringType))
        more = {"createTableColumnTypes": types} if types else {}
        rows.write.format("jdbc").options(**self.options(), dbtable=self.named(name), batchsize=str(BATCH), numPartitions=str(writers), **more).mode("overwrite").save()

    def require_keys(self, name: str, keys: Sequence[str], rows: int) -> None:
        """As many rows as said, no null and no repeated key; the database counts."""
        cols = [self.quoted(k) for k in keys]
        null = " OR ".join(f"{c} IS NULL" for c in cols)
        groups = f"SELECT {', '.join(cols)}, COUNT(*) AS times FROM {self.named(name)} GROUP BY {', '.join(cols)}"
        n, nulls, repeated = self.query(f"SELECT COALESCE(SUM(times), 0) AS n, COUNT(CASE WHEN {null} THEN 1 END) AS nulls, COUNT(CASE WHEN times > 1 THEN 1 END) AS repeated FROM ({groups}) g").first()
        if n != rows or nulls or repeated:
            raise QualityError(f"{name}: rows {n} of {rows}, null keys {nulls}, repeated keys {repeated}")

    def promote(self, load: str, target: str, columns: Sequence[str], in_place: bool = False) -> None:
        """`load` becomes `target` in one transaction. in_place: the target's table stays and gets the rows, for views that hang on it; else names change only."""
        retired = f"{target}_retired"
        with self.connection() as c:
            if not self.has(c, target):
                self.run(c, self.rename(load, target))
            elif in_place:
                names = ", ".join(self.quoted(x) for x in columns)
                self.run(c, f"DELETE FROM {self.named(target)}", f"INSERT INTO {self.named(target)} ({names}) SELECT {names} FROM {self.named(load)}", f"DROP TABLE {self.named(load)}")
            else:
                self.run(c, self.rename(target, retired), self.rename(load, target), f"DROP TABLE {self.named(retired)}")

    def load(self, rows: DataFrame, target: str, keys: Sequence[str], compared: Sequence[str] = (), writers: int = WRITERS, in_place: bool = False, fail: Callable[[str], None] = lambda step: None) -> int:
        """Writes, checks and promotes; returns the number of rows. fail: called with each step before it, for tests that let it crash there."""
        beside = f"load_{target}"
        self.create_schema()
        n = rows.count()  # of files, only their footers
        self.write(rows, beside, [*keys, *compared], writers)
        fail("check")
        self.require_keys(beside, keys, n)
        fail("promote")
        self.promote(beside, target, rows.columns, in_place)
        fail("verify")
        self.require_keys(target, keys, n)
        return n


def in_one_process(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's process."""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def embedded(spark: SparkSession, folder: str, schema: str = "STAGING") -> Database:
    """A database in a local folder, in this process: only where all tasks run in it too."""
    if not in_one_process(spark):
        raise RuntimeError("an embedded database is only seen by its own process")
    path = "/" + folder.removeprefix("file:").lstrip("/")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{path}.log")
    return Database(spark, f"jdbc:derby:{path};create=true", schema, {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "user": "app", "password": "app"})
