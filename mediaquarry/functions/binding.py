"""Name an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once.

    A Column used twice is two copies of its tree, and nested rules multiply the copies; a lambda
    variable keeps the plan as long as the rules themselves.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
