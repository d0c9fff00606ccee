"""Loads every plan module so that all queries are registered."""

from . import documents, evidence, records, screening  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
