"""All queries of the library and their SQL; the modules named here add theirs to the catalogue."""

from quern import column_tests, databases, protocols, validations  # noqa: F401
from quern.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
