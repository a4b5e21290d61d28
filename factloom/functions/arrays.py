"""Sets and ordered lists held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_distinct(items: Column, most: int | None = None) -> Column:
    own = F.array_distinct(items)
    return own if most is None else F.slice(own, 1, most)


def within(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def all_different(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def same_set(a: Column, b: Column) -> Column:
    return within(a, b) & within(b, a)
