"""Per-page checks as column expressions over the page and its feature struct ``d``.

Each check is a column of an array of issues. All arrays are concatenated and exploded once, so a
run over all checks is one narrow stage after the parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.model import ISSUE

EMPTY = f"array<struct<{', '.join(x.replace(' ', ':') for x in ISSUE.split(', '))}>>"


def none() -> Column:
    return F.array().cast(EMPTY)


def when(cond: Column, one: Column) -> Column:
    """The issue if the condition is true; null conditions are false."""
    return F.when(F.coalesce(cond, F.lit(False)), F.array(one)).otherwise(none())


def each(items: Column, make: Callable[[Column], Column]) -> Column:
    """One issue per item."""
    return F.coalesce(F.transform(items, make), none())


def repeated(n: Column, one: Column) -> Column:
    """The same issue ``n`` times."""
    return F.coalesce(F.array_repeat(one, F.coalesce(n, F.lit(0))), none())


def guarded(guard: Column, parts: list[Column]) -> Column:
    return F.when(F.coalesce(guard, F.lit(False)), F.concat(*parts)).otherwise(none())
