"""Registered queries over the test tables and their SQL."""

from .queries import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
