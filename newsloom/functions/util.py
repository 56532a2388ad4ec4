"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame) -> DataFrame:
    """Same rows, but filters on them are not pushed below.

    A filter on a computed column is otherwise copied under the projections
    that compute it, column in column; with deep projections the copies grow
    without bound. A generator that makes one row per row stops that, and the
    columns are computed once.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return any_of(text.contains(p) for p in parts)


def blank(text: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(text, F.lit("")) == ""


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def hash32(text: Column) -> Column:
    """Unsigned 32-bit number from the md5 of ``text``; the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
