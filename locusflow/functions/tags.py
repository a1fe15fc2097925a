"""Values of alignment tags ('type:value' by name) as typed Columns; null where a tag is missing or of another type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(tag: Column) -> Column:
    """The type letter: A, i, f, Z, H or B."""
    return F.substring(tag, 1, 1)


def _of(tag: Column, kinds: str) -> Column:
    return F.when(kind(tag).isin(*kinds), F.substring(tag, F.lit(3), F.length(tag)))


def integer(tag: Column) -> Column:
    return _of(tag, "i").try_cast("bigint")


def number(tag: Column) -> Column:
    """Of whole numbers too."""
    return _of(tag, "if").try_cast("double")


def letter(tag: Column) -> Column:
    return _of(tag, "A")


def words(tag: Column) -> Column:
    """A text, or an array of bytes in hexadecimal digits."""
    return _of(tag, "ZH")


def values(tag: Column) -> Column:
    """A numeric array's values; the first letter of its text is the type of each."""
    return F.transform(F.slice(F.split(_of(tag, "B"), ","), 2, F.greatest(F.size(F.split(_of(tag, "B"), ",")) - 1, F.lit(0))), lambda x: x.try_cast("double"))
