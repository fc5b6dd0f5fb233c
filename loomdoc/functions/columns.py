"""Help with column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` takes it inside functions of elements."""
    return F.transform(F.array(value), use)[0]
