"""Queries over the test tables, each with the SQL it must agree with."""

from . import cards, documents, edges, filters, metrics, mining, routes, sales, texts, usage  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
