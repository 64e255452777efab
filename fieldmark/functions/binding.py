"""Values that an expression needs several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value as a lambda's variable, so that the plan holds and runs its expression once."""
    return F.transform(F.array(value), use)[0]
