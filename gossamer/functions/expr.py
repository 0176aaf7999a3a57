"""Small builders for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def struct(**fields: Column) -> Column:
    """A struct with explicit names: inside lambdas, names given by alias can be lost when a generator stands in the same projection."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))
