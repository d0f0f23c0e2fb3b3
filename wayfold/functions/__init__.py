"""Scalar functions of the ride analytics engine, as expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.plans.relation import _dialect


def column(expression: str) -> Column:
    """The Column of an expression in the shared dialect."""
    return F.expr(_dialect(expression, False))
