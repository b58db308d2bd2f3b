"""Staged tables, the registered queries, and the SQL they are checked against."""
