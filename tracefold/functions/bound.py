"""Naming a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` where `value` is evaluated, and written into the plan, once however often `use`
    needs it."""
    return F.transform(F.array(value), use)[0]
