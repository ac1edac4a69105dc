"""Queries over the standard tables, each a composition of operators, with SQL for the same rows."""

from . import analytics, retrieval, tables  # noqa: F401  they register their queries
