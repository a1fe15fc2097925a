"""Small array and text helpers with fixed edge cases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split(text: Column, delimiter: str) -> Column:
    """Parts between delimiters, empty ones kept; the delimiter is taken literally."""
    return F.split(text, re.escape(delimiter), -1)


def split_numbers(text: Column, delimiter: str, kind: str = "double") -> Column:
    """Parts as numbers; what isn't one is 0."""
    return F.transform(split(text, delimiter), lambda x: F.coalesce(x.try_cast(kind), F.lit(0).cast(kind)))


def cut(array: Column, start: int, stop: int) -> Column:
    """Elements start to stop (half-open, from 0), as far as there are any."""
    return F.slice(array, start + 1, max(0, stop - start))


def first_least(array: Column) -> Column:
    """The index (from 0) of the first smallest element."""
    return F.array_position(array, F.array_min(array)) - 1


def first_greatest(array: Column) -> Column:
    return F.array_position(array, F.array_max(array)) - 1
