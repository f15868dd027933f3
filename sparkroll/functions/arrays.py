"""Small helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also when the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def last(items: Column) -> Column:
    return F.element_at(items, -1)
