"""Registered query plans over the test tables and the SQL that states each of them."""

from . import relational_queries, statistics_queries  # noqa: F401  they fill the registry
