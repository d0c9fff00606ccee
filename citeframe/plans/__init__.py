"""Registered queries: each a Spark plan over the given tables plus equivalent SQL."""

from . import registry  # noqa: F401
