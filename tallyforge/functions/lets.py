"""Values that are worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value stands in a lambda's variable: a column that is named twice is worked out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
